"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, acceptor again.

Words are letter runs of whole texts, some of them with one letter left out as a checksum of id and run says, counted over
all rows. Counting, cutting and the checksum are DataFrame functions.

Composition. A pair of words at one edit reads the same letters up to the edit and again after it. So the composed machine
begins in states that both words reach by the same letters, and those initial states deal the work: words go by their
first ``HEAD`` letters, and mirrored by their last ``TAIL``. Edits after the head are found in the first dealing; the
others leave the tail alone (words have ``HEAD + TAIL`` letters at least) and are found in the second, where at most
``HEAD - 1`` letters may follow the edit. In each initial state the words' rests make a minimal acyclic acceptor, whose
states know how many words they end, so that a word is its rank. From each of its states the transducer replaces or
deletes one letter and the acceptor reads on with the rests that both branches share; these are kept by pair of states,
which minimal acceptors share widely. A deletion takes the last letter of its run, so a pair is accepted once.

Hot initial states. One that holds more than ``most`` words makes its first composed step in Spark: words are grouped by
what is left without the letter at that place (equal rests, at most one word of each letter), and all go on into initial
states that are one letter longer. So no task holds more than ``most`` words at once, whatever the vocabulary.

Words of more than ``LONG`` letters, too deep for a chain of states, are grouped by two 64-bit hashes of the word
without each of its letters in turn; those of one group are at one edit.

Null texts have no words, null ids are written as empty text in the checksum, repeated rows count again. An empty table
or one without repeated words gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Store
from tidemark.llm.textscan import BASES, mix, powers

LETTERS = "a-zÀ-ÿ"
#: Letters that a word needs, and occurrences.
LEAST, TWICE = 7, 2
#: One run in so many loses a letter; a form is so many times as frequent.
SKIP, TIMES = 31, 10
HEAD, TAIL, LONG = 3, 4, 200
#: Words that one initial state composes at once.
MOST = 5_000
FOUND = "word string, near long, best_n long, best string"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST letters that occur at least TWICE."""
    low = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"))
    sums = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.when(F.col("h") % SKIP == 0, without("run", place)).otherwise(F.col("run"))
    return sums.select(cut.alias("word")).filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= TWICE)


def without(word: str, place: Column | int) -> Column:
    """The word without the letter at a place (from 0)."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.concat(F.substr(F.col(word), F.lit(1), place), F.substr(F.col(word), place + 2))


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct strings; ``count`` is the strings that a state ends, an arc's
    offset their rank among the state's before those of the arc."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.least: list[int] = []
        register: dict[tuple, int] = {}
        path, letters, last = [[False, []]], [], ""

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                arcs, at = {}, int(node[0])
                for c, to in node[1]:
                    arcs[c] = (to, at)
                    at += self.count[to]
                register[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(node[0])
                self.count.append(at)
                self.least.append(0 if node[0] else 1 + min((self.least[to] for _, to in node[1]), default=0))
            return register[key]

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((letters.pop(), settle(node)))

        for s in strings:
            k = 0
            for a, b in zip(last, s):
                if a != b:
                    break
                k += 1
            fold(k)
            for c in s[k:]:
                path.append([False, []])
                letters.append(c)
            path[-1][0] = True
            last = s
        fold(0)
        self.root = settle(path[0])

    def composed(self, rest: int) -> tuple[list[int], list[int]]:
        """Ranks of all pairs at one edit with at most ``rest`` letters behind it (negative: any number), each once."""
        arcs, final, count, least = self.arcs, self.final, self.count, self.least
        shared: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        found: dict[int, list[tuple[int, int]]] = {}

        def both(p: int, q: int, left: int, but: str = "") -> list[tuple[int, int]]:
            """Rank pairs of the strings that both states end, in which the letter ``but`` does not come first."""
            if p == q and left < 0 and not but:
                return [(k, k) for k in range(count[p])]
            if not but and (p, q, left) in shared:
                return shared[p, q, left]
            out = [(0, 0)] if final[p] and final[q] else []
            if left:
                a, b = arcs[p], arcs[q]
                for c in a.keys() & b.keys() if len(a) < len(b) else b.keys() & a.keys():
                    if c != but:
                        (to, at), (to2, at2) = a[c], b[c]
                        out += [(x + at, y + at2) for x, y in both(to, to2, left - 1)]
            if not but:
                shared[p, q, left] = out
            return out

        def edits(q: int) -> list[tuple[int, int]]:
            out: list[tuple[int, int]] = []
            if 0 <= rest < least[q] - 1:
                return out
            steps = list(arcs[q].items())
            for k, (a, (to, at)) in enumerate(steps):
                for _, (to2, at2) in steps[k + 1 :]:
                    out += [(x + at, y + at2) for x, y in both(to, to2, rest)]  # another letter
                out += [(x + at, y) for x, y in both(to, q, rest, a)]  # the letter left out
            return out

        def walk(q: int) -> list[tuple[int, int]]:
            if q not in found:
                out = edits(q)
                for to, at in arcs[q].values():
                    out += [(x + at, y + at) for x, y in walk(to)]
                found[q] = out
            return found[q]

        pairs = walk(self.root)
        return [x for x, _ in pairs], [y for _, y in pairs]


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Of the pairs a, b (places in words), per word how many there are and the most frequent other word."""
    if not len(a):
        return None
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], me))
    first = order[np.append(True, me[order][1:] != me[order][:-1])]
    at, best = me[first], other[first]
    near = np.bincount(me, minlength=len(words))[at]
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in at], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())], ["word", "near", "best_n", "best"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], list[int]]]:
    key, words, counts = None, [], []
    for batch in batches:
        for k, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if words:
                    yield key, words, counts
                key, words, counts = k, [], []
            words.append(w)
            counts.append(n)
    if words:
        yield key, words, counts


def _composer(mirrored: bool):
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of key, w, n: the accepted pairs of each initial state, summed by word."""
        for key, words, counts in _groups(batches):
            if len(words) < 2:
                continue
            a, b = Acceptor([w[len(key) :] for w in words]).composed(HEAD - 1 if mirrored else -1)
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            if mirrored:
                words = [w[::-1] for w in words]
                heads = np.unique([w[:HEAD] for w in words], return_inverse=True)[1]
                a, b = a[heads[a] != heads[b]], b[heads[a] != heads[b]]
            out = _best(words, np.array(counts, np.int64), a, b)
            if out is not None:
                yield out

    return compose


def _sharing(items: DataFrame, other_head: bool = False) -> DataFrame:
    """items: key, plain (the key is the word itself), last (its letter is the last of its run), n, word. Words of a key
    without a letter differ in that letter; one that is the key differs from them by it. A key has a word of each letter."""
    grouped = items.groupBy("key").agg(F.collect_set(F.struct("plain", "last", "n", "word")).alias("all")).filter(F.size("all") > 1)
    me = grouped.select(F.explode("all").alias("me"), "all")

    def near(x: Column) -> Column:
        one = F.when(x["plain"], F.col("me.last") & ~F.col("me.plain")).when(F.col("me.plain"), x["last"]).otherwise(x["word"] != F.col("me.word"))
        return one & (F.left(x["word"], F.lit(HEAD)) != F.left(F.col("me.word"), F.lit(HEAD))) if other_head else one

    kept = me.select(F.col("me.word").alias("word"), F.filter("all", near).alias("others")).filter(F.size("others") > 0)
    best = F.array_min(F.transform("others", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    return kept.select("word", F.size("others").cast("long").alias("near"), best.alias("best")).select("word", "near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _dealt(words: DataFrame, store: Store, mirrored: bool, most: int) -> list[DataFrame]:
    """The pairs of one dealing, as tables of FOUND."""
    side = "tail" if mirrored else "head"
    size = TAIL if mirrored else HEAD
    read = F.reverse("word") if mirrored else F.col("word")
    open_ = words.select(read.alias("w"), "n").withColumn("key", F.left("w", F.lit(size)))
    tables, found, level = [], [], 0
    while True:
        many = open_.groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("hot"))
        if not (many := store.put(many, f"{side}-many-{level}")).take(1):
            tables.append(open_)
            break
        marked = store.put(open_.join(many, "key", "left"), f"{side}-{level}")
        tables.append(marked.filter("hot is null").drop("hot"))
        hot = marked.filter("hot and length(w) >= length(key)").select("w", "n", "key")
        # the composed step at the letter behind the key
        here = hot.filter(F.length("w") > F.length("key"))
        if mirrored:
            here = here.filter(F.length("w") <= F.length("key") + HEAD)
        place, turned = F.length("key"), F.reverse("w") if mirrored else F.col("w")
        last = F.substr(F.col("w"), place + 1, F.lit(1)) != F.substr(F.col("w"), place + 2, F.lit(1))
        cut = here.select(place.alias("size"), without("w", place).alias("rest"), F.lit(False).alias("plain"), last.alias("last"), "n", turned.alias("word"))
        whole = hot.select(place.alias("size"), F.col("w").alias("rest"), F.lit(True).alias("plain"), F.lit(False).alias("last"), "n", turned.alias("word"))
        items = cut.unionByName(whole).select(F.concat_ws(":", F.col("size").cast("string"), "rest").alias("key"), "plain", "last", "n", "word")
        found.append(store.put(_sharing(items, mirrored), f"{side}-found-{level}"))
        open_, size, level = hot.filter(F.length("w") > F.length("key")).withColumn("key", F.left("w", F.length("key") + 1)), size + 1, level + 1
    rest = tables[0]
    for t in tables[1:]:
        rest = rest.unionByName(t)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // most + 1)
    sorted_ = rest.select("key", "w", "n").repartition(parts, "key").sortWithinPartitions("key", "w")
    found.append(store.put(sorted_.mapInArrow(_composer(mirrored), FOUND), f"{side}-composed"))
    return found


def _without_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, word -> items by hash: the word itself and without the last letter of each run (they meet at a deletion),
    and without each letter by its place (they meet where one letter differs)."""
    for batch in batches:
        for i, n, word in zip(*(c.to_pylist() for c in batch.columns)):
            code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            size, keys = len(code), []
            for base in BASES:
                up, down = powers(base, size + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[:size], dtype=np.uint64)])
                behind = (sums[-1] - sums[1:]) * down[1]  # one place further left
                keys.append([f"{h:016x}" for h in mix(np.append(sums[:-1] + behind, sums[-1])).tolist()])
            last = np.append(code[1:] != code[:-1], True)
            key = [f"at {k} of {size}:{keys[0][k]}{keys[1][k]}" for k in range(size)]
            key += [f"{size - 1}:{keys[0][k]}{keys[1][k]}" for k in np.flatnonzero(last)] + [f"{size}:{keys[0][-1]}{keys[1][-1]}"]
            plain = np.zeros(len(key), bool)
            plain[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(plain), *(pa.array(np.full(len(key), x, np.int64)) for x in (n, size, i))], ["key", "plain", "n", "size", "id"])


def _long(words: DataFrame, store: Store, long: int) -> DataFrame:
    """The pairs of words of which one at least has more than long letters, by numbers that follow the words' order."""
    numbered = store.put(words.repartitionByRange(words.count() // 10_000 + 1, "word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "n", "word"), "long")
    items = numbered.mapInArrow(_without_each, "key string, plain boolean, n long, size long, id long")
    grouped = items.groupBy("key").agg(F.collect_set(F.struct("plain", "n", "size", "id")).alias("all")).filter(F.size("all") > 1)
    pairs = grouped.select("key", F.explode("all").alias("me"), "all").select("key", "me", F.explode("all").alias("x")).filter("me.id <> x.id and greatest(me.size, x.size) > " + str(int(long)))
    # a deletion's items meet the word itself, not each other
    pairs = pairs.filter(F.startswith("key", F.lit("at ")) | (F.col("me.plain") != F.col("x.plain")))
    best = pairs.groupBy("me.id").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("x.n")).alias("n"), F.col("x.id").alias("id"))).alias("best"))
    named = numbered.select("id", "word")
    out = best.join(named, "id").select("word", "near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("id"))
    return store.put(out.join(named.withColumnRenamed("word", "best"), "id").select("word", "near", "best_n", "best"), "long-found")


def _roots(forms: DataFrame, store: Store) -> DataFrame:
    """word, form: the last form of each chain, by doubling; forms are ten times as frequent, so chains end."""
    at, level = store.put(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further, level = store.put(further, f"roots-{level + 1}"), level + 1
        store.drop(f"roots-{level - 1}")
        at = further.select("word", "root")
        if not further.filter("moved").take(1):
            return at


def spelling_variants(docs: DataFrame, most: int = MOST, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    store = Store(docs.sparkSession, "spelling")
    words = store.put(vocabulary(docs, id_col, text_col), "words")
    short = words.filter(F.length("word") <= long)
    found = [*_dealt(short, store, False, most), *_dealt(short, store, True, most)]
    # a word of long letters may be near one with a letter more
    deep = store.put(words.filter(F.length("word") >= long), "deep")
    if deep.filter(F.length("word") > long).take(1):
        found.append(_long(deep, store, long))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    near = store.put(all_.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best")), "near")
    joined = words.join(near, "word", "left")
    much = F.col("best_n") >= TIMES * F.col("n")
    judged = store.put(joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(much, F.col("best")).alias("form"), F.when(much, F.col("best_n")).alias("form_n")), "judged")
    roots = _roots(judged.filter("form is not null"), store)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
