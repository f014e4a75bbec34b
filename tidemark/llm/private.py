"""Personal data by candidate generation and boosted trees, in DataFrame functions only.

Base spans follow four fixed formats with their checks and always stay. High-recall generators propose more, overlapping
freely: values after secret-like keywords, local telephone numbers, grouped identity numbers, account codes, long
hexadecimal and digit strings. Format and context features of all candidates are small whole numbers, so Spark groups
all candidates of the corpus to a short table of feature patterns with counts; the driver fits boosted trees of depth
two on that table (its size is bounded by the product of the features' values, not by the corpus). Labels come from
checks of the value alone that no feature sees: Luhn, ranges of addresses and of telephone, area and identity numbers,
the account checksum modulo 97, the number of different characters of secrets and codes. So the trees learn which
format and context go with sound values. The score of each pattern becomes a map column. Thresholds are calibrated by
cross-fitting: texts fall into two folds by hash, each fold is scored by the trees of the other, and a kind's threshold
is the lowest held-out score at which the sound share of its candidates above reaches ``precision``. Of overlapping
candidates the best score stays, and none that a base span touches.

Long texts. Work grows with a text's length and its matches: starts are running sums of the lengths between and of the
matches, context is taken from what stands between them, and overlaps are settled in one fold over the spans in order of
their starts, in which at most one span of each kind is open. Arrays that a fold appends to are blocks of ``BLOCK``
elements, so that appending does not copy the whole.

Positions count code points. Null texts are empty. Ids are carried as they are, nulls and repeats included. A column of
docs named ``pii_spans`` is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns equal to the plain ones, written so that no match is tried twice and no repetition is nested on the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only whole runs of 13 to 19 digits with single separators; a run is maximal, so others fail whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SMALL = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{SMALL}\.{SMALL}\.{SMALL}\.{SMALL}$"
BASE = ("email", "ip", "card", "phone")
#: The further generators: kind, a cheap test of the whole text, pattern.
MORE = (
    ("secret", "[=:]", r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?[A-Za-z0-9_./+-]{6,64}[\"']?"),
    ("local_phone", "[0-9]", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("identity", "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account", "[A-Z][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("code", "[0-9]", r"(?<![A-Za-z0-9])(?=[a-f0-9]*[0-9])[a-f0-9]{12,64}(?![A-Za-z0-9])"),
)
KEYWORD = r"(?i)(?:pass|pwd|token|secret|key|card|phone|tel|call|mail|account|iban|ssn|id)[^\p{L}]{0,4}$"
ROUNDS, RATE, PRECISION = 40, 0.3, 0.9
#: Different characters of a sound secret or code, at least.
VARIED = 10
FEATURES = ("keyword", "separated", "length", "digits", "mixed", "before", "after")
BLOCK = 256
CONTEXT = 24
SPAN = "struct<start:int,end:int,kind:string,base:boolean,score:double,rank:int,alive:boolean>"


def blocks(name: str, size: int = BLOCK) -> Column:
    """The array in a column (not an expression, which lambdas would evaluate anew each time), cut into arrays of size."""
    n = F.size(name)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int")), lambda k: F.slice(F.col(name), k * size + 1, F.lit(size)))
    return F.filter(cut, lambda b: F.size(b) > 0)


def running(df: DataFrame, name: str) -> DataFrame:
    """df with the array of whole numbers in a column replaced by its sums up to each element."""
    sums = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    local = df.withColumn(name, F.transform(blocks(name), sums))
    before = sums(F.transform(name, lambda b: F.element_at(b, -1)))
    return local.withColumn(name, F.flatten(F.zip_with(name, F.slice(before, F.lit(1), F.size(name)), lambda b, o: F.transform(F.slice(b, F.lit(2), F.size(b)), lambda x: x + o))))


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((2 * F.substring(digits, i, F.lit(1)).cast("int")) % 10 + F.floor(2 * F.substring(digits, i, F.lit(1)).cast("int") / 10).cast("int")),
    )
    return total % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_VALID)
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "local_phone":
        return F.regexp_replace(value, "[^0-9]", "").rlike("^[2-9][0-8][0-9][2-9][0-9]{2}")
    if kind == "identity":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "account":
        return _mod97(value) == 1
    if kind in ("secret", "code"):
        different = F.size(F.array_distinct(F.split(F.regexp_replace(value, "^.*[=:][\\x20]*|[\"']", ""), "")))
        return different >= VARIED
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """Remainder of an account code, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def add(acc: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), add)


def _candidate(kind: str, value: Column, start: Column, end: Column, left: Column, right: Column) -> Column:
    """left: up to CONTEXT code points before the value; right: the one behind it."""
    sides = lambda c: F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike("[=:\"'(#]"), 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)
    n = end - start
    digit = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.struct(
        F.lit(kind).alias("kind"),
        start.alias("start"),
        end.alias("end"),
        _sound(kind, value).alias("sound"),
        (left.rlike(KEYWORD) | F.lit(kind == "secret")).cast("int").alias("keyword"),
        value.rlike(r"[\x20.()-]").cast("int").alias("separated"),
        F.when(n < 10, 0).when(n < 14, 1).when(n < 20, 2).when(n < 30, 3).otherwise(4).alias("length"),
        F.floor(4 * digit / (n + 1)).cast("int").alias("digits"),
        (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).cast("int").alias("mixed"),
        sides(F.right(left, F.lit(1))).alias("before"),
        sides(right).alias("after"),
    )


def candidates(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column ``name``: base matches and all further proposals, sound or not, with features. Texts that
    cannot match a pattern are not searched."""
    t = F.col("text")
    digits = t.rlike("[0-9]")
    found = {"email": (F.contains(t, F.lit("@")), EMAIL), "ip": (digits, IP), "card": (digits, CARD), "phone": (F.contains(t, F.lit("+")), PHONE)}
    found |= {kind: (t.rlike(test), pattern) for kind, test, pattern in MORE}
    none = F.expr("cast(array() as array<string>)")
    value, gap, end = ({kind: f"{prefix}_{kind}" for kind in found} for prefix in ("value", "gap", "end"))
    seen = df.select(F.struct(*[c for c in df.columns if c != name]).alias("row"), F.col(text).alias("text"))
    seen = seen.withColumns({value[k]: F.when(likely & t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, (likely, p) in found.items()})
    seen = seen.withColumns({gap[k]: F.when(F.size(value[k]) > 0, F.split("text", p, -1)).otherwise(none) for k, (_, p) in found.items()})
    seen = seen.withColumns({end[k]: F.zip_with(F.slice(F.col(gap[k]), F.lit(1), F.size(value[k])), value[k], lambda g, v: F.length(g) + F.length(v)) for k in found})
    for k in found:
        seen = running(seen, end[k])

    def judged(kind: str) -> Column:
        at = lambda c, i: F.coalesce(F.get(F.col(c), i), F.lit(""))

        def one(v: Column, i: Column) -> Column:
            stop = F.get(F.col(end[kind]), i)
            left = F.right(F.concat(F.right(at(gap[kind], i - 1), F.lit(CONTEXT)), at(value[kind], i - 1), at(gap[kind], i)), F.lit(CONTEXT))
            right = F.left(F.concat(F.left(at(gap[kind], i + 1), F.lit(1)), at(value[kind], i + 1)), F.lit(1))
            return _candidate(kind, v, F.get(F.col(end[kind]), i) - F.length(v), stop, left, right)

        return F.transform(value[kind], one)

    return seen.select("row.*", F.concat(*[judged(k) for k in found]).alias(name))


Tree = tuple[tuple[int, int], tuple[tuple[int, int], float, float], tuple[tuple[int, int], float, float]]


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Gradient boosting of depth-two trees (tests: feature <= value) on patterns x with labels y and counts n."""
    p0 = float(np.clip((n * y).sum() / n.sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), bias)
    tests = [(f, v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1].tolist()]
    trees: list[Tree] = []
    if not tests:
        return bias, trees

    def value(g: np.ndarray, h: np.ndarray) -> float:
        return float(g.sum() / (h.sum() + 1.0))

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[int, int], float]:
        gain = []
        for f, v in tests:
            left = rows & (x[:, f] <= v)
            right = rows & ~left
            gain.append(g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1))
        k = int(np.argmax(gain))
        return tests[k], gain[k]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)
        root, _ = best(np.ones(len(y), bool), g, h)
        sides = []
        for rows in (x[:, root[0]] <= root[1], x[:, root[0]] > root[1]):
            test, _ = best(rows, g, h)
            low, high = rows & (x[:, test[0]] <= test[1]), rows & (x[:, test[0]] > test[1])
            a, b = rate * value(g[low], h[low]), rate * value(g[high], h[high])
            score[low] += a
            score[high] += b
            sides.append((test, a, b))
        trees.append((root, sides[0], sides[1]))
    return bias, trees


def tree_score(bias: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), bias)
    for root, low, high in trees:
        for rows, (test, a, b) in ((x[:, root[0]] <= root[1], low), (x[:, root[0]] > root[1], high)):
            out += np.where(rows, np.where(x[:, test[0]] <= test[1], a, b), 0.0)
    return 1 / (1 + np.exp(-out))


def learn(texts: DataFrame, precision: float = PRECISION) -> tuple[dict[tuple[int, ...], float], dict[str, float]]:
    """texts: text. Score of each feature pattern and threshold of each further kind (2: none is taken)."""
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")
    # outer: for a plain explode Spark infers a filter, which it writes out in all steps below
    patterns = candidates(texts.select("text", fold), "text", "all").select("fold", F.explode_outer("all").alias("c")).filter("c is not null").groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in ("kind", "sound", *FEATURES)])
    seen = patterns.count().orderBy("kind", "fold", "sound", *FEATURES).collect()  # one order, so that reruns agree
    cuts = {kind: 2.0 for kind, _, _ in MORE}
    if not seen:
        return {}, cuts
    x, y, n = np.array([[r[f] for f in FEATURES] for r in seen]), np.array([float(r.sound) for r in seen]), np.array([float(r["count"]) for r in seen])
    kinds, folds = np.array([r.kind for r in seen]), np.array([r.fold for r in seen])
    score = tree_score(*boost(x, y, np.log1p(n)), x)
    held = score.copy()  # a fold without candidates leaves the other to its own trees
    for k in (0, 1):
        if (folds == k).any() and (folds != k).any():
            held[folds == k] = tree_score(*boost(x[folds != k], y[folds != k], np.log1p(n[folds != k])), x[folds == k])
    for kind in cuts:
        own = kinds == kind
        levels = [s for s in np.unique(held[own]) if (n * y)[own & (held >= s)].sum() >= precision * n[own & (held >= s)].sum()]
        if levels:
            cuts[kind] = float(min(levels))
    return {tuple(row): float(s) for row, s in zip(x.tolist(), score)}, cuts


def private_spans(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and pii_spans, array of kind, start, end, base (bool), ordered by kind as listed, then start."""
    docs = docs.drop("pii_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    scores, cuts = learn(docs.select(text.alias("text")), precision)
    table = F.create_map(*[F.lit(v) for pattern, s in scores.items() for v in (",".join(map(str, pattern)), s)]) if scores else F.expr("cast(map() as map<string,double>)")
    cut = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])
    order = {k: i for i, k in enumerate([*BASE, *cuts])}
    rank = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])

    def judged(c: Column) -> Column:
        is_base = c["kind"].isin(*BASE)
        score = F.coalesce(F.try_element_at(table, F.concat_ws(",", *[c[f].cast("string") for f in FEATURES])), F.lit(0.0))
        take = F.when(is_base, c["sound"]).otherwise(score >= F.element_at(cut, c["kind"]))
        span = {"start": c["start"], "end": c["end"], "kind": c["kind"], "base": is_base, "score": score, "rank": F.element_at(rank, c["kind"]), "alive": F.lit(True)}
        return F.struct(*[v.alias(k) for k, v in span.items()], take.alias("take"))

    def better(a: Column, b: Column) -> Column:
        return a["base"] | (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["start"] < b["start"]))))

    fields = ("start", "end", "kind", "base", "score", "rank")
    marked = lambda s, alive: F.struct(*[s[f].alias(f) for f in fields], alive.alias("alive"))

    def step(acc: Column, s: Column) -> Column:
        """Spans that ended go out; the others and the new one lose to what is better and touches them."""
        ended = F.filter(acc["open"], lambda a: a["end"] <= s["start"])
        touched = F.filter(acc["open"], lambda a: a["end"] > s["start"])
        still = F.transform(touched, lambda a: marked(a, a["alive"] & ~better(s, a)))
        return F.struct(F.concat(still, F.array(marked(s, ~F.exists(touched, lambda a: better(a, s))))).alias("open"), F.concat(acc["out"], ended).alias("out"))

    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    block = lambda acc, b: F.aggregate(b, F.struct(acc["open"].alias("open"), empty.alias("out")), step, lambda r: F.struct(r["open"].alias("open"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    start = F.struct(empty.alias("open"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))
    seen = candidates(docs.select(F.struct("*").alias("doc"), text.alias("text")), "text", "all")
    spans = F.transform(F.filter(F.transform("all", judged), lambda c: c["take"]), lambda c: F.struct(*[c[f].alias(f) for f in (*fields, "alive")]))
    seen = seen.select("doc", F.array_sort(spans).alias("spans"))
    settled = seen.select("doc", F.aggregate(blocks("spans"), start, block, lambda r: F.concat(F.flatten(r["out"]), r["open"])).alias("spans"))
    kept = F.transform(F.filter("spans", lambda c: c["base"] | c["alive"]), lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base")))
    return settled.select("doc.*", F.transform(F.array_sort(kept), lambda c: F.struct(*[c[f].alias(f) for f in ("kind", "start", "end", "base")])).alias("pii_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_spans -> text with every span replaced by its kind in brackets; touching spans become one."""
    columns = [c for c in docs.columns if c != "pii_spans"]
    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("doc"), F.col(text_col).alias("text"), by_start.alias("spans"))
    text = F.col("text")

    # a block's spans are cut out of its own part of the text (here), which begins where the block before ended (base)
    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        new = F.concat(acc["out"], F.substring(acc["here"], acc["at"] - acc["base"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.when(fresh, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"), acc["here"].alias("here"), acc["base"].alias("base"))

    def block(acc: Column, b: Column) -> Column:
        here = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), F.element_at(b, -1)["start"] - acc["at"]))
        first = F.struct(acc["at"].alias("at"), F.lit("").alias("out"), here.alias("here"), acc["at"].alias("base"))
        return F.aggregate(b, first, add, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(blocks("spans"), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select("doc", F.when(F.size("spans") > 0, done).otherwise(text).alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in columns])
