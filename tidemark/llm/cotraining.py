"""Quality classifier by co-training.

Two views of a document: its text (shares of its words in ``HASHED`` hashed classes, and of symbols, capitals, marks,
short, repeated and bar words, repeated lines and so on) and its page metadata (source, language, recorded length). Each view has a logistic classifier fitted on labelled
rows. In each round both score all unlabelled rows, and the rows of which one is most confident become labelled rows of
the other, in the proportion of the classes. At the end both are calibrated on labelled rows that neither was fitted on,
and a last logistic regression over the two calibrated views scores all documents.

The driver sees a bounded sample of labelled rows only: at most ``sample``, by hash of the id, each weighed by how many
labelled rows it stands for. Unlabelled rows stay in the cluster: the cuts of confidence come from a grouped histogram,
the Newton steps from grouped sums of gradients and Hessians, and what a row was given follows from the weights and cuts
of the rounds before. Without labels of both classes every document scores 0.5 and is kept. Null texts are
empty; null metadata is a value like others, a missing metadata column a constant; rows with null or repeated ids are
scored like others, and never dropped. Columns of docs named like the results (q_text, q_meta, q_score, q_kept) are
replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.repetition import SYMBOL
from tidemark.llm.store import Store
from tidemark.llm.textscan import SPACE, Words, steps, texts
from tidemark.llm.toxicity import fit_logistic, logistic

#: Labelled rows that the driver sees, at most.
SAMPLE = 20_000
ROUNDS, SHARE, CONFIDENT, CUT = 4, 0.05, 0.8, 0.5
SOURCES, LANGS = 32, 8
#: Bins of the log-odds from that of CONFIDENT to 30; parts that the labels are dealt to in the join with repeated ids.
BINS, SALTS = 4096, 16
TEXT = ["words", "word_bytes", "symbols", "capitals", "digits", "stops", "shouts", "bars", "wide", "symbol_ends", "short", "echo", "distinct", "lines", "dup_lines", "longest"]
#: Classes of hashed words, which follow the other text features.
HASHED = 32
WIDTH = len(TEXT) + HASHED
RESULTS = ("q_text", "q_meta", "q_score", "q_kept")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    upper, digit, stop = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91], digit[48:58], stop[[ord(c) for c in ".,;:"]] = True, True, True
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(1)):
            words, rows = Words(data, offsets), b - a
            n = np.diff(words.first)
            h = words.hashes()
            count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[offsets[1:]] - c[offsets[:-1]]
            by_word = lambda flags: np.bincount(words.row, weights=flags, minlength=rows)
            length = words.end - words.start
            last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
            echo = np.zeros(len(words), bool)
            if len(words) > 1:
                echo[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
            distinct = np.array([len(np.unique(h[s:e])) for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist())])
            raw, lines, dups = data.tobytes(), [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                solid = [x for x in raw[s:e].split(b"\n") if x.strip()]
                lines.append(len(solid))
                dups.append((len(solid) - len(set(solid))) / max(1, len(solid)))
            longest = np.zeros(rows)
            np.maximum.at(longest, words.row, length)
            solid, per = np.maximum(count(~SPACE[data]), 1), np.maximum(n, 1)
            parts = [
                np.log1p(n), by_word(length) / per / 8, count(SYMBOL[data]) / solid, count(upper[data]) / solid, count(digit[data]) / solid, count(stop[data]) / solid,
                count(data == 0x21) / per, by_word((length == 1) & (last == 0x7C)) / per, count(data >= 0x80) / solid, by_word(SYMBOL[last]) / per, by_word(length <= 3) / per,
                by_word(echo) / per, distinct / per, np.log1p(lines) / np.log1p(per + 1), np.array(dups), np.log1p(longest),
            ]
            bag = (h >> np.uint64(40)).astype(np.int64) % HASHED
            shares = np.bincount(words.row * HASHED + bag, minlength=rows * HASHED).reshape(rows, HASHED) / per[:, None]
            x = np.column_stack([*parts, shares]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(list(x), pa.list_(pa.float64()))], ["row", "text_x"])


def _metadata(docs: DataFrame) -> Column:
    """Page metadata as numbers: one-hot hashes of source and language, and the logarithm of the recorded length."""
    have = set(docs.columns)
    hashed = lambda c, n: [(F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)) == k).cast("double") for k in range(n)] if c in have else [F.lit(0.0)] * n
    size = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)))) if "n_chars" in have else F.lit(0.0)
    return F.array(size, *hashed("source", SOURCES), *hashed("lang", LANGS))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both views of a row as one string of doubles."""
    for batch in batches:
        if batch.num_rows:
            x = np.column_stack([batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def _views(column: pa.Array) -> list[np.ndarray]:
    data, offsets = texts(column)
    x = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.float64).reshape(len(column), -1)
    return [x[:, :WIDTH], x[:, WIDTH:]]


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _bins(odds: np.ndarray, confident: float) -> np.ndarray:
    """Bin of the log-odds; negative below the least confidence."""
    low = np.log(confident / (1 - confident))
    return np.minimum(np.floor((odds - low) / (30 - low) * BINS), BINS - 1).astype(np.int64)


def _given(x: list[np.ndarray], history: list, confident: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are still free after the rounds (weights and cuts of both views), and each view's labels (-1: none)."""
    free, label = np.ones(len(x[0]), bool), [np.full(len(x[0]), -1) for _ in x]
    for weights, cuts in history:
        given = []
        for k in (0, 1):
            odds = _odds(weights[k], x[k])
            given += [(1 - k, free & (_bins(s, confident) >= cuts[k, y]), y) for y, s in ((1, odds), (0, -odds))]
        for to, at, y in given:
            label[to][at] = y
            free &= ~at
    return free, label


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian of logistic regression, in one array."""
    z, odds = np.column_stack([x, np.ones(len(x))]), _odds(w, x)
    p = 1 / (1 + np.exp(-odds))
    return np.concatenate([[(y * odds - np.logaddexp(0, odds)).sum()], z.T @ (y - p), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])


def confident_cuts(pool: DataFrame, weights: list[np.ndarray], history: list, wanted: dict[int, int], confident: float) -> dict[tuple[int, int], int]:
    """The bin from which each view gives rows of each class, by a histogram of all free rows: bins are taken whole, from
    the top, until there are ``wanted`` rows. A view that is sure of fewer rows of one class gives fewer of the other in
    proportion, so that what it gives never shifts the balance of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BINS), np.int64)
        for batch in batches:
            x = _views(batch.column(0))
            free, _ = _given(x, history, confident)
            for k in (0, 1):
                odds = _odds(weights[k], x[k][free])
                for y, s in ((1, odds), (0, -odds)):
                    at = _bins(s, confident)
                    total[k, y] += np.bincount(at[at >= 0], minlength=BINS)
        k, y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (k, y, at, total[k, y, at])], ["k", "y", "bin", "n"])

    found: dict[tuple[int, int], dict[int, int]] = {(k, y): {} for k in (0, 1) for y in (0, 1)}
    for r in pool.mapInArrow(run, "k long, y long, bin long, n long").groupBy("k", "y", "bin").agg(F.sum("n").alias("n")).collect():
        found[r.k, r.y][r.bin] = r.n
    cuts = {}
    for (k, y), counts in found.items():
        part = min(1.0, *(sum(found[k, c].values()) / n for c, n in wanted.items()))
        taken, cuts[k, y] = 0, BINS
        for at in sorted(counts, reverse=True):
            if taken < part * wanted[y]:
                taken, cuts[k, y] = taken + counts[at], at
    return cuts


def pool_sums(pool: DataFrame, weights: list[np.ndarray], history: list, confident: float) -> list[np.ndarray]:
    """_sums of each view over all rows that it was given, added up in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 + len(w) + len(w) ** 2) for w in weights]
        for batch in batches:
            x = _views(batch.column(0))
            _, label = _given(x, history, confident)
            for k in (0, 1):
                at = label[k] >= 0
                total[k] += _sums(x[k][at], label[k][at], weights[k])
        flat = np.concatenate(total)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], ["at", "v"])

    size = [1 + len(w) + len(w) ** 2 for w in weights]
    out = np.zeros(sum(size))
    for r in pool.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return [out[: size[0]], out[size[0] :]]


def fit_views(views: list[np.ndarray], y: np.ndarray, weight: float, start: list[np.ndarray], pool: DataFrame, history: list, confident: float, ridge: float = 1.0) -> list[np.ndarray]:
    """Newton steps of both views at once, halved while they do not improve: labelled rows of the driver and all rows that
    the rounds have given."""
    penalty = [np.append(np.full(len(w) - 1, ridge), 1e-6) for w in start]

    def at(ws: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """The penalised likelihood and the step from there."""
        out = []
        for k, far in enumerate(pool_sums(pool, ws, history, confident)):
            total, n = far + weight * _sums(views[k], y, ws[k]), len(ws[k])
            value = total[0] - (penalty[k] * ws[k] ** 2).sum() / 2
            out.append((value, np.linalg.solve(total[1 + n :].reshape(n, n) + np.diag(penalty[k]), total[1 : n + 1] - penalty[k] * ws[k])))
        return out

    w = [v.copy() for v in start]
    best, scale = at(w), [1.0, 1.0]
    for _ in range(40):
        if all(np.abs(scale[k] * best[k][1]).max() < 1e-6 for k in (0, 1)):
            break
        trial = [w[k] + scale[k] * best[k][1] for k in (0, 1)]
        new = at(trial)
        for k in (0, 1):
            if new[k][0] >= best[k][0] - 1e-9 * abs(best[k][0]):
                w[k], best[k], scale[k] = trial[k], new[k], 1.0
            else:
                scale[k] /= 2
    return w


def co_train(views: list[np.ndarray], y: np.ndarray, weight: float, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE, confident: float = CONFIDENT) -> list[np.ndarray]:
    """Weights of both views after exchanging confident pseudo-labels over rounds; pool: x, all unlabelled rows."""
    rows, history = pool.count(), []
    weights = [fit_logistic(v, y) for v in views]
    for _ in range(rounds if rows else 0):
        wanted = {label: max(1, int(share * rate * rows)) for label, rate in ((1, y.mean()), (0, 1 - y.mean()))}
        history = [*history, (weights, confident_cuts(pool, weights, history, wanted, confident))]
        weights = fit_views(views, y, weight, weights, pool, history, confident)
    return weights


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All columns of docs and q_text, q_meta (calibrated views), q_score, q_kept."""
    store = Store(docs.sparkSession, "cotraining")
    docs = docs.drop(*RESULTS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.xxhash64(text), F.lit(SALTS)).alias("salt"), _metadata(docs).alias("meta_x")).alias("row"), text.alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    marks = store.put(marks.groupBy("doc_id").agg(F.min("label").alias("label")), "marks")
    chosen = store.put(marks.orderBy(F.xxhash64("doc_id")).limit(sample), "labelled")
    seen = store.put(base.mapInArrow(_measure, "row struct<doc_id:long,salt:long,meta_x:array<double>>, text_x array<double>").select("row.*", "text_x"), "seen")
    own = seen.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")  # at most sample ids; of texts of one id always the same
    found = own.agg(F.min(F.struct(F.xxhash64("text_x", "meta_x").alias("h"), "text_x", "meta_x", "label")).alias("r")).select("doc_id", "r.*")
    known = found.select("label", "meta_x", "text_x", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).alias("fold")).toPandas()
    dealt = marks.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    # Spark's size check knows nothing of the explode, so the dealt labels would be broadcast; rows are sorted and merged
    free = seen.filter("doc_id is not null").join(dealt.hint("merge"), ["doc_id", "salt"], "left_anti").select("text_x", "meta_x").unionByName(seen.filter("doc_id is null").select("text_x", "meta_x"))
    zero = [np.zeros(WIDTH + 1), np.zeros(1 + SOURCES + LANGS + 1)]
    last = np.zeros(3)
    if len(known) and known.label.nunique() == 2:
        arrays = lambda f: [np.array(f[c].tolist()) for c in ("text_x", "meta_x")]
        train, check = known[known.fold != 0], known[known.fold == 0]
        if train.label.nunique() < 2 or check.label.nunique() < 2:
            train = check = known
        pool = store.put(free.mapInArrow(_pack, "x binary"), "pool")
        store.drop("seen")
        zero = co_train(arrays(train), train.label.to_numpy(float), marks.count() / chosen.count(), pool, rounds)
        store.drop("pool")
        y = check.label.to_numpy(float)
        views = arrays(check)
        for k in (0, 1):  # calibration: a line through the view's log-odds
            s, c = fit_logistic((views[k] @ zero[k][:-1] + zero[k][-1])[:, None], y)
            zero[k] = np.append(zero[k][:-1] * s, zero[k][-1] * s + c)
        last = fit_logistic(np.column_stack([views[k] @ zero[k][:-1] + zero[k][-1] for k in (0, 1)]), y)
    work = docs.select(F.struct(*docs.columns).alias("doc"), _metadata(docs).alias("meta_x"))
    work = work.select(F.struct("doc", "meta_x").alias("row"), F.coalesce(F.col(f"doc.{text_col}"), F.lit("")).alias("text"))
    schema = T.StructType([work.schema["row"], T.StructField("text_x", T.ArrayType(T.DoubleType()))])
    work = work.mapInArrow(_measure, schema).select("row.doc", "row.meta_x", "text_x")
    work = work.select("doc", logistic(zero[0], "text_x").alias("q_text"), logistic(zero[1], "meta_x").alias("q_meta"))
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(float(last[0]) * odds("q_text") + float(last[1]) * odds("q_meta") + float(last[2]))))
    return work.withColumn("q_score", score).select("doc.*", "q_text", "q_meta", "q_score", (F.col("q_score") >= cut).alias("q_kept"))
