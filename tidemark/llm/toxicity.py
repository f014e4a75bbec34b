"""Toxicity by Levenshtein automata over a learnt lexicon trie, with context windows.

Lexicon. From a bounded sample of labelled rows (``sample``, by hash of the id), every word and every prefix of three to
eight letters of a word is counted once per document, in toxic and in other documents. Those with enough toxic documents
and hardly any others are terms: whole words as they are, prefixes as stems (shortest first, none inside a kept one).
Words are runs of letters of any script, in learning and in scanning; what stands between two spaces and holds several
runs ("id1ot") is read once more as one word.

Automaton. The terms form a trie. Its states are intersected with the Levenshtein automaton of distance one (insertion,
deletion, substitution) and made deterministic, so one table of byte transitions reads a word and tells whether it is a
term, begins with a stem, or is a misspelt term or begins with a misspelt stem. Terms of at least ``fuzzy`` letters are
found with an edit after the first letter. Other edits (in the first letter, of short terms, of stems) are allowed term
by term, if the sample's benign documents hold few such words that stand in one of them only; benign words next to a
term are no hits. All words of a block of texts step through the table together, and words leave at the first byte that
leads nowhere.

Context. Each hit is weighed by its window of bytes on both sides: inside quotation marks, or after a reporting word, it
counts less. Repeated and neighbouring hits count more.

Score. Logistic regression on six counts of weighed hits and their density, fitted on the driver to the sample, then
applied to all documents. Labels, language, source and id are never inputs. Null and empty texts score like texts
without hits. Documents without a label are scored all the same. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Store
from tidemark.llm.textscan import Words, steps

#: Labelled rows that the lexicon and the weights are learnt from, at most.
SAMPLE = 30_000
#: Terms and stems kept, at most; documents that a term needs; share of its documents that must be toxic.
TERMS, SUPPORT, PRECISION, FUZZY = 400, 4, 0.9, 5
CUT = 0.3
# Words that report speech.
REPORTING = ("said", "says", "called", "quote", "quoted", "wrote", "dit", "sagte", "dijo")
# Quotation marks in UTF-8.
QUOTES = ('"', "“", "”", "«", "»", "„")

#: Kinds of edits, as bits: after the first letter, and of it.
INNER, FIRST = 1, 2
RUN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether RUN takes it for a letter."""
    out = np.zeros(0x110000, bool)
    for m in RUN.finditer("".join(map(chr, range(0xD800)))):
        out[m.start() : m.end()] = True
    for m in RUN.finditer("".join(map(chr, range(0xE000, 0x110000)))):
        out[0xE000 + m.start() : 0xE000 + m.end()] = True
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters."""
    table = _letters()
    out = table[data] & (data < 0x80)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        c0, c1, c2, c3 = (wide[lead + k] for k in range(4))
        size = np.where(c0 < 0xE0, 2, np.where(c0 < 0xF0, 3, 4))
        two, three = (c0 & 31) << 6 | c1 & 63, (c0 & 15) << 12 | (c1 & 63) << 6 | c2 & 63
        code = np.where(size == 2, two, np.where(size == 3, three, (c0 & 7) << 18 | (c1 & 63) << 12 | (c2 & 63) << 6 | c3 & 63))
        found = table[np.minimum(code, len(table) - 1)]
        for k in range(4):
            out[lead[found & (k < size)] + k] = True
    return out


class Automaton:
    """Deterministic table of the lexicon trie with and without one edit. Verdicts: 0 none, 1 misspelt, 2 stem, 3 term.

    ``edits`` has the kinds of edits that each term, and each stem with a star behind it, is found with; without it terms
    of ``fuzzy`` letters are found with inner ones. Words in ``benign`` are not misspelt."""

    def __init__(self, terms: list[bytes], stems: list[bytes], fuzzy: int = FUZZY, edits: dict[bytes, int] | None = None, benign: list[bytes] = ()):
        if edits is None:
            edits = {w: INNER for w in terms if len(w) >= fuzzy}
        trie: list[dict[int, int]] = [{}]
        kind: dict[int, int] = {}
        below: dict[int, int] = {0: 0}  # kinds of edits of the terms and stems at a node or below
        ends: dict[int, int] = {}
        heads: dict[int, int] = {}
        safe = set()

        def add(word: bytes, allowed: int) -> int:
            at = 0
            below[0] |= allowed
            for c in word:
                if c not in trie[at]:
                    trie.append({})
                    trie[at][c] = len(trie) - 1
                at = trie[at][c]
                below[at] = below.get(at, 0) | allowed
            return at

        for w in terms:
            at = add(w, edits.get(w, 0))
            kind[at], ends[at] = 3, edits.get(w, 0)
        for w in stems:
            at = add(w, edits.get(w + b"*", 0))
            kind[at], heads[at] = max(kind.get(at, 0), 2), edits.get(w + b"*", 0)
        stem_nodes = set(heads)
        for w in benign:
            safe.add(add(w, 0))
        known = sorted({c for w in [*terms, *stems, *benign] for c in w})
        other = 0  # a byte that no term holds
        alphabet = [other, *known]
        passed = (-1, INNER)  # a misspelt stem is behind

        # a state of the product: a set of (trie node, kind of the edit used or 0)
        def close(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            out = set(states)
            for node, e in states:
                if e == 0:
                    bit = INNER if node else FIRST
                    out |= {(to, bit) for to in trie[node].values() if below[to] & bit}  # a letter left out
            out = {(n, e) for n, e in out if e == 0 or (n, 0) not in out}
            if any(e and heads.get(n, 0) & e for n, e in out):
                out.add(passed)
            return frozenset(out)

        def step(states: frozenset[tuple[int, int]], c: int) -> frozenset[tuple[int, int]]:
            out = set()
            for node, e in states:
                if node < 0:
                    out.add(passed)
                    continue
                to = trie[node].get(c)
                if to is not None and (e == 0 or below[to] & e):
                    out.add((to, e))
                if e == 0:
                    bit = INNER if node else FIRST
                    out |= {(to, bit) for to in trie[node].values() if below[to] & bit}  # another letter
                    if below[node] & bit:
                        out.add((node, bit))  # a letter too many
            return close(out)

        start, names, todo = close({(0, 0)}), {}, []
        names[frozenset()] = 0
        names[start] = 1
        todo.append(start)
        rows: list[list[int]] = [[0] * 256, [0] * 256]
        verdict, sticky = [0, 0], [0, 0]
        while todo:
            states = todo.pop()
            row = rows[names[states]]
            for c in alphabet:
                to = step(states, c)
                if to not in names:
                    names[to] = len(rows)
                    rows.append([0] * 256)
                    stem = any(e == 0 and n in stem_nodes for n, e in to)
                    exact = any(e == 0 and kind.get(n) == 3 for n, e in to)
                    near = passed in to or any(e and ends.get(n, 0) & e for n, e in to)
                    near = near and not any(e == 0 and n in safe for n, e in to)
                    verdict.append(3 if exact else 2 if stem else 1 if near else 0)
                    sticky.append(2 if stem else 1 if to == {passed} else 0)
                    todo.append(to)
                row[c] = names[to]
            for c in range(256):
                if c not in alphabet:
                    row[c] = row[other]
        self.table = np.array(rows, np.int32)
        self.verdict, self.sticky = np.array(verdict, np.int8), np.array(sticky, np.int8)

    def read(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Verdict of each word data[start:end] (folded bytes)."""
        out = np.zeros(len(start), np.int8)
        live, at, state = np.arange(len(start)), start.copy(), np.ones(len(start), np.int32)
        while len(live):
            done = at >= end[live]
            if done.any():
                out[live[done]] = self.verdict[state[done]]
                live, at, state = live[~done], at[~done], state[~done]
                if not len(live):
                    break
            state = self.table[state, data[at]]
            found = self.sticky[state] > 0
            if found.any():
                out[live[found]] = self.sticky[state[found]]
            on = (state != 0) & ~found
            live, at, state = live[on], at[on] + 1, state[on]
        return out


def scan(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, list[tuple[int, int, int]]]:
    """Runs of letters of lower-case texts, the verdict of each, and the hits as (run, start, end). What stands between
    spaces and holds several runs without a hit is read as one word too, whose verdict its first run gets."""
    runs = Words(data, offsets, letters(data))
    hit = automaton.read(data, runs.start, runs.end)
    spots = [(k, int(runs.start[k]), int(runs.end[k])) for k in np.flatnonzero(hit).tolist()]
    whole = Words(data, offsets)
    a, b = np.searchsorted(runs.start, whole.start), np.searchsorted(runs.start, whole.end)
    total = np.concatenate([[0], np.cumsum(hit > 0)])
    mixed = (b - a > 1) & (total[b] == total[a])
    a, b = a[mixed], b[mixed]
    joined = automaton.read(data, runs.start[a], runs.end[b - 1])
    for k in np.flatnonzero(joined).tolist():
        hit[a[k]] = joined[k]
        spots.append((int(a[k]), int(runs.start[a[k]]), int(runs.end[b[k] - 1])))
    return runs, hit, spots


FEATURES = ["terms", "stems", "misspelt", "quoted", "clustered", "density"]


def _features(automaton: Automaton, window: int):
    marks = [np.frombuffer(q.encode(), np.uint8) for q in QUOTES]
    reporting = Automaton([w.encode() for w in REPORTING], [], fuzzy=99)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(pc.utf8_lower(batch.column(1))):
                words, hit, _ = scan(automaton, data, offsets)
                at = np.flatnonzero(hit)
                rows = b - a
                row = words.row[at]
                weight = np.ones(len(at))
                if len(at):
                    raw = data.tobytes()
                    for k, w in enumerate(at.tolist()):
                        s, e = int(offsets[row[k]]), int(offsets[row[k] + 1])
                        left, right = raw[max(s, words.start[w] - window) : words.end[w]], raw[words.start[w] : min(e, words.end[w] + window)]
                        quoted = any(bytes(q) in left for q in marks) and any(bytes(q) in right for q in marks)
                        lo = max(int(words.first[row[k]]), w - 4)
                        told = bool(reporting.read(data, words.start[lo:w], words.end[lo:w]).any()) if quoted and w > lo else False
                        weight[k] = 0.25 if told else 0.6 if quoted else 1.0
                near = np.zeros(len(at), bool)
                if len(at) > 1:
                    close = (np.diff(at) <= 12) & (row[1:] == row[:-1])
                    near[1:] |= close
                    near[:-1] |= close
                sums = lambda x: np.bincount(row, weights=x, minlength=rows)
                kind = hit[at]
                n = np.maximum(np.diff(words.first), 1)
                full = sums(weight)
                parts = [sums(weight * (kind == 3)), sums(weight * (kind == 2)), sums(weight * (kind == 1)), sums(1 - weight), sums(weight * near), full / n]
                parts = [np.log1p(p) for p in parts[:-1]] + [np.log1p(100 * parts[-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(np.stack(parts, axis=1)), pa.list_(pa.float64()))], ["doc_id", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; the last weight is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(weights: np.ndarray, column: str) -> F.Column:
    parts = [F.lit(float(w)) * F.col(column)[k] for k, w in enumerate(weights[:-1])]
    total = F.lit(float(weights[-1]))
    for p in parts:
        total = total + p
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _heads(text: str | None) -> set[str]:
    """The words of a lower-case text (marked by =) and their prefixes of three to eight letters."""
    words = {w for w in RUN.findall(text or "") if len(w) > 2}
    return {"=" + w for w in words} | {w[:n] for w in words for n in range(3, min(8, len(w)) + 1)}


def _count_terms(wanted: frozenset[str] | None):
    """Documents by term, summed within the task before anything is shuffled; only the wanted terms, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in pc.utf8_lower(batch.column(0)):
                heads = _heads(text.as_py())
                found.update(heads if wanted is None else heads & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    return run


def learn_lexicon(labelled: DataFrame, support: int = SUPPORT, precision: float = PRECISION, most: int = TERMS) -> tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int]]:
    """labelled: text, label (a bounded sample) -> terms, stems and the words that begin with a stem, with their toxic
    documents. Terms of ``support`` toxic documents are counted first, then how many other documents hold them; their
    number is bounded by the sample."""
    count = lambda label, wanted: labelled.filter(F.col("label") == label).select("text").mapInArrow(_count_terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    bad = {r.term: r.n for r in count(1, None).filter(F.col("n") >= support).collect()}
    good = {r.term: r.n for r in count(0, frozenset(bad)).collect()} if bad else {}
    bad = {t: n for t, n in bad.items() if n >= precision * (n + good.get(t, 0))}
    words = {t[1:]: n for t, n in bad.items() if t.startswith("=")}
    heads = {t: n for t, n in bad.items() if not t.startswith("=")}
    stems: dict[str, int] = {}
    for t in sorted(heads, key=lambda t: (len(t), -heads[t], t)):
        if not any(t[:k] in stems for k in range(3, len(t) + 1)):
            stems[t] = heads[t]
    # a stem whose documents all hold one whole word says no more than that word
    leading: dict[str, int] = {}
    for w, n in words.items():
        for k in range(3, min(8, len(w)) + 1):
            leading[w[:k]] = max(leading.get(w[:k], 0), n)
    stems = {s: n for s, n in stems.items() if leading.get(s, 0) < 0.9 * n}
    covered = {w: n for w, n in words.items() if any(w[:k] in stems for k in range(3, min(8, len(w)) + 1))}
    terms = {w: n for w, n in words.items() if w not in covered}
    best = lambda d: {w.encode(): d[w] for w in sorted(d, key=lambda w: (-d[w], w))[:most]}
    return best(terms), best(stems), best(covered)


def edit_kinds(word: bytes, term: bytes) -> int:
    """The kinds of one edit that make the term the word; 0 if none does."""
    if word == term:
        return 0
    a, b = word[1:], term[1:]
    first = FIRST if a == b or word == b or a == term else 0
    if word[:1] != term[:1]:
        return first
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return first | (INNER if a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] else 0)


def _near_words(automaton: Automaton):
    """Misspelt words and how many toxic and other documents hold them, summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, _, data, offsets in steps(pc.utf8_lower(batch.column(0))):
                words, hit, spots = scan(automaton, data, offsets)
                raw = data.tobytes()
                for row, word in {(int(words.row[k]), raw[s:e]) for k, s, e in spots if hit[k] == 1}:
                    found[word][labels[a + row]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["word", "good", "bad"])

    return run


def learn_edits(labelled: DataFrame, terms: dict[bytes, int], stems: dict[bytes, int], covered: dict[bytes, int], support: int = SUPPORT, precision: float = PRECISION) -> tuple[dict[bytes, int], list[bytes]]:
    """The kinds of edits that each term and stem may be found with, and the benign words next to them.

    Words that one benign document of the sample holds tell how many unseen ones there are (Good and Turing): a kind of
    edits is allowed if, counted against it, they leave the term its precision."""
    count = {**terms, **covered, **{s + b"*": n for s, n in stems.items()}}
    every = Automaton([*terms, *covered], list(stems), edits=dict.fromkeys(count, INNER | FIRST))
    near = labelled.select("text", "label").mapInArrow(_near_words(every), "word binary, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    shorter = lambda w: {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}
    index = defaultdict(set)
    for key in count:
        for w in shorter(key.rstrip(b"*")):
            index[w, key.endswith(b"*")].add(key)
    longest = max(map(len, stems), default=-1) + 1
    single, kinds = Counter(), []
    for r in near:
        word, found = bytes(r.word), defaultdict(int)
        for key in {k for w in shorter(word) for k in index.get((w, False), ())}:
            found[key] |= edit_kinds(word, key)
        for n in range(1, min(longest, len(word)) + 1):
            for key in {k for w in shorter(word[:n]) for k in index.get((w, True), ())}:
                found[key] |= edit_kinds(word[:n], key[:-1])
        pairs = {(key, bit) for key, bits in found.items() for bit in (INNER, FIRST) if bits & bit}
        kinds.append((word, r.good, r.bad, pairs))
        if r.good == 1 and r.bad == 0:
            single.update(pairs)
    always = {(w, INNER) for w in (*terms, *covered) if len(w) >= FUZZY}
    allowed = always | {(key, bit) for key, n in count.items() for bit in (INNER, FIRST) if n >= precision * (n + single[key, bit])}
    edits = {key: sum(bit for bit in (INNER, FIRST) if (key, bit) in allowed) for key in count}
    benign = [w for w, good, bad, pairs in kinds if pairs & allowed and bad < precision * (good + bad) and (good >= support or not pairs & always)]
    return edits, benign


def toxicity(docs: DataFrame, labels: DataFrame, window: int = 60, sample: int = SAMPLE, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, and the features. Labels are used only where
    crc32(doc_id as text) mod 4 is not 2. A null text is empty and scores like one; null and repeated ids are scored like
    others (a null id is not held out, and never a labelled row); other columns are not read; an empty table gives an
    empty one; without labels of both classes every score is near 0."""
    store = Store(docs.sparkSession, "toxicity")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    marks = marks.filter(~held).groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id")).limit(sample)
    own = base.join(F.broadcast(store.put(marks, "marks")), "doc_id").groupBy("doc_id")  # of texts of one id always the same
    labelled = store.put(own.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")).select("doc_id", "r.text", "r.label"), "labelled")
    terms, stems, covered = learn_lexicon(labelled)
    edits, benign = learn_edits(labelled, terms, stems, covered) if terms or stems else ({}, [])
    run = _features(Automaton([*terms, *covered], list(stems), edits=edits, benign=benign), window)
    schema = "doc_id long, x array<double>"
    train = store.put(labelled.select("doc_id", "text").mapInArrow(run, schema).join(labelled.select("doc_id", "label"), "doc_id").select("label", "x"), "train").toPandas()
    if len(train) and train.label.nunique() == 2:
        weights = fit_logistic(np.array(train.x.tolist()), train.label.to_numpy(float))
    else:
        weights = np.append(np.zeros(len(FEATURES)), -30.0)
    scored = base.mapInArrow(run, schema).withColumn("score", logistic(weights, "x"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *[F.col("x")[k].alias(f"x_{f}") for k, f in enumerate(FEATURES)])
