"""Exact dedup of byte strings: every byte covered by a string of ``least`` bytes that starts elsewhere too.

1. Anchors. Each window of ``least`` bytes holds a minimiser of ``gram`` bytes (about one byte in a hundred is one);
   equal windows hold equal ones. Grouping finds the anchors that occur twice; a join marks where they stand.
2. Slices. The run of windows with one anchor is a slice: windows lo..hi of a text, placed from -reach to 0 against the
   anchor. What all windows of such a range of places hold is its core, first the anchor itself. Equal slices are settled
   at once by grouping: all their windows repeat. One of each stays a witness. A slice whose core no different slice
   shares is done.
3. Buckets. Slices that share a core meet in a bucket, and breadth-first backward extension over the Burrows-Wheeler
   transform of its bytes (``bwt.py``) finds the windows with a common prefix of ``least`` bytes.
4. Hot buckets, of more than ``bucket`` slices, are split before that: the range of places is halved, which
   makes the cores longer and so tells more contexts apart. Halving ends at single windows, where core and slice
   are the window itself and grouping settles it; so no group is ever gathered whole.

Everything depends on the text alone, so texts are known by two 64-bit hashes; slices are equal by SHA-256. A text that occurs in several rows, if
it is long enough, goes whole in each. Nulls in any column are fine; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bwt import repeated_starts
from tidemark.llm.store import Store
from tidemark.llm.textscan import BASES, minimizers, prefix_sums, rolling, span_hash, steps, texts

LEAST = 400
GRAM = 200
#: Slices of one core that a task takes together; more are split by longer cores.
BUCKET = 100
#: Bytes of buckets that one transform takes.
BLOCK = 1 << 19
SLICE = "t1 long, t2 long, lo int, hi int, at int, near int, far int, core long, whole binary"
NAMES = ["t1", "t2", "lo", "hi", "at", "near", "far", "core", "whole"]


def _chosen(data: np.ndarray, offsets: np.ndarray, gram: int, least: int):
    """Anchor of each run of windows and the runs' first and last windows inside single rows: row, place, lo, hi."""
    place, first = minimizers(rolling(data.astype(np.uint64) + np.uint64(1), gram), least - gram + 1)
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    last = np.append(first[1:], len(data) - least + 1) - 1
    row = np.searchsorted(offsets, place, "right") - 1
    lo, hi = np.maximum(first, offsets[row]), np.minimum(last, offsets[row + 1] - least)
    # a run that crosses a border between rows belongs to the row of its anchor, or has windows of its own before it
    ok = hi >= lo
    return row[ok], place[ok], lo[ok], hi[ok]


def _anchors(gram: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, _, data, offsets in steps(batch.column(2)):
                row, place, _, _ = _chosen(data, offsets, gram, least)
                if len(row):
                    h = rolling(data.astype(np.uint64) + np.uint64(1), gram)[place].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t1[a + row]), pa.array(t2[a + row]), pa.array(h), pa.array((place - offsets[row]).astype(np.int32))], ["t1", "t2", "gram", "pos"])

    return run


def _hashes(data: np.ndarray, core: tuple[np.ndarray, np.ndarray], whole: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """A hash of each core, which only chooses buckets, and the digest of each slice, by which slices are equal."""
    sums, raw = prefix_sums(data.astype(np.uint64) + np.uint64(1), BASES[0]), data.tobytes()
    digests = [sha256(raw[s:e]).digest() for s, e in zip(whole[0].tolist(), whole[1].tolist())]
    return [pa.array(span_hash(sums, *core, BASES[0]).view(np.int64)), pa.array(digests, pa.binary())]


def _ints(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.astype(np.int32)) for x in columns]


def _slices(gram: int, least: int):
    """t1, t2, text, marks -> the slices round the marked anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b, data, offsets in steps(batch.column(2)):
                part = batch.column(3).slice(a, b - a)
                marks = np.asarray(part.flatten(), dtype=np.int64) + np.repeat(offsets[:-1], np.asarray(part.value_lengths()))
                row, place, lo, hi = _chosen(data, offsets, gram, least)
                marked = np.isin(place, marks)
                row, place, lo, hi = row[marked], place[marked], lo[marked], hi[marked]
                if len(row):
                    hashes = _hashes(data, (place, place + gram), (lo, hi + least))
                    o, zero = offsets[row], np.zeros(len(row))
                    yield pa.RecordBatch.from_arrays([pa.array(t1[a + row]), pa.array(t2[a + row]), *_ints(lo - o, hi - o, place - o, zero - (least - gram), zero), *hashes], NAMES)

    return run


def _fetch(least: int):
    """t1, t2, text, asked (the other columns of NAMES) -> the slices with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b, data, offsets in steps(batch.column(2)):
                part = batch.column(3).slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                fields = [part.flatten().field(i) for i in range(len(NAMES) - 2)]
                raw, begin = data.tobytes(), offsets[row]
                cut = [raw[s:e] for s, e in zip((begin + fields[0].to_numpy()).tolist(), (begin + fields[1].to_numpy() + least).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(t1[a + row]), pa.array(t2[a + row]), *fields, pa.array(cut, pa.binary())], [*NAMES, "bytes"])

    return run


def _halve(least: int):
    """Slices with bytes -> their windows in either half of the range of places, with the longer cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(7)]
            for a, b, data, offsets in steps(batch.column(len(NAMES))):
                lo, hi, at, near, far = (x[a:b].astype(np.int64) for x in columns[2:])
                raw, mid = data.tobytes(), (near + far) // 2
                for low, high in ((near, mid), (mid + 1, far)):
                    s, e = np.maximum(lo, at + low), np.minimum(hi, at + high)
                    k = np.flatnonzero((e >= s) & (high >= low))
                    if not len(k):
                        continue
                    shift = offsets[:-1][k] - lo[k]
                    hashes = _hashes(data, (shift + at[k] + high[k], shift + at[k] + low[k] + least), (shift + s[k], shift + e[k] + least))
                    cut = [raw[x:y] for x, y in zip((shift + s[k]).tolist(), (shift + e[k] + least).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0][a + k]), pa.array(columns[1][a + k]), *_ints(s[k], e[k], at[k], low[k], high[k]), *hashes, pa.array(cut, pa.binary())], [*NAMES, "bytes"])

    return run


def _match(least: int, block_bytes: int):
    """Slices with bytes, buckets in order -> repeated windows as spans of their texts."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        t1, t2, lo, hi = (table.column(i).to_numpy() for i in range(4))
        parts, starts = [], []
        for x, n in zip(table.column(len(NAMES)).to_pylist(), (hi - lo + 1).tolist()):
            s = np.zeros(len(x) + 1, bool)
            s[:n] = True
            starts.append(s)
            parts.append(np.frombuffer(x, np.uint8) + np.uint8(2))
            parts.append(np.ones(1, np.uint8))
        parts[-1] = np.zeros(1, np.uint8)
        starts = np.concatenate(starts)
        found = repeated_starts(np.concatenate(parts), starts, least)
        begin = np.cumsum(np.append(0, [len(p) + 1 for p in parts[::2]]))[:-1]
        found &= starts
        edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            return None
        k = np.searchsorted(begin, s, "right") - 1
        shift = lo[k] - begin[k]
        return pa.RecordBatch.from_arrays([pa.array(t1[k]), pa.array(t2[k]), pa.array((s + shift).astype(np.int32)), pa.array((e - 1 + shift + least).astype(np.int32))], ["t1", "t2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            core, length = batch.column(7).to_numpy(), np.diff(texts(batch.column(len(NAMES)))[1])
            cuts = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
            for s, e in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                if held and size > block_bytes and held[-1].column(7)[-1].as_py() != int(core[s]):
                    if out := settle(held):
                        yield out
                    held, size = [], 0
                held.append(batch.slice(s, e - s))
                size += int(length[s:e].sum())
        if held and (out := settle(held)):
            yield out

    return run


def repeated_bytes(docs: DataFrame, least: int = LEAST, gram: int = GRAM, bucket: int = BUCKET, text_col: str = "text") -> DataFrame:
    """Spans of bytes to remove, by text: t1, t2, start, end (-1: the whole text)."""
    spark = docs.sparkSession
    store = Store(spark, "suffix")
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    long_ = base.filter(F.octet_length("text") >= least).select("t1", "t2", "text")
    anchors = store.put(long_.mapInArrow(_anchors(gram, least), "t1 long, t2 long, gram long, pos int"), "anchors")
    # the same place of equal texts counts once: copies are settled by their number of rows alone
    place = F.xxhash64("t1", "t2", "pos")
    shared = store.put(anchors.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b").select("gram"), "shared")
    marks = store.put(anchors.join(shared, "gram", "left_semi").groupBy("t1", "t2").agg(F.collect_set("pos").alias("marks")), "marks")
    store.drop("anchors", "shared")
    twice = store.put(long_.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    # marks and asked grow with the corpus, so these joins always shuffle; a text of several rows gives its slices once
    slices = store.put(long_.join(marks.hint("merge"), ["t1", "t2"]).mapInArrow(_slices(gram, least), SLICE).distinct(), "slices")
    store.drop("marks")

    def witness(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Spans of slices that occur twice; of each slice that shares its core with a different one, its witness and the bucket's size."""
        classes = store.put(rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "lo", "hi", "at", "near", "far")).alias("one")), f"{name}-classes")
        same = rows.join(classes.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("t1", "t2", F.col("lo").alias("start"), (F.col("hi") + least).alias("end"))
        cores = store.put(classes.groupBy("core").agg(F.count("*").alias("slices")).filter("slices > 1"), f"{name}-cores")
        open_ = classes.join(cores, "core").select("one.*", "core", "whole", "slices")
        found = store.put(same, f"{name}-same"), store.put(open_, f"{name}-open")
        store.drop(f"{name}-classes", f"{name}-cores")
        return found

    same, open_ = witness(slices, "0")
    spans = [same]
    asked = store.put(open_.groupBy("t1", "t2").agg(F.collect_list(F.struct(*NAMES[2:])).alias("asked")), "asked")
    rows = store.put(long_.join(asked.hint("merge"), ["t1", "t2"]).mapInArrow(_fetch(least), SLICE + ", bytes binary").distinct(), "rows-0")
    store.drop("slices", "asked")
    sizes, level = open_.select("t1", "t2", "lo", "hi", "slices"), 0
    while True:
        sized = rows.join(sizes, ["t1", "t2", "lo", "hi"])
        cool = sized.filter(F.col("slices") <= bucket).drop("slices")
        spans.append(store.put(cool.repartition("core").sortWithinPartitions("core").mapInArrow(_match(least, BLOCK), "t1 long, t2 long, start int, end int"), f"{level}-match"))
        hot = sized.filter(F.col("slices") > bucket).drop("slices")
        if not hot.take(1):
            break
        level += 1
        rows = store.put(hot.mapInArrow(_halve(least), SLICE + ", bytes binary"), f"rows-{level}")
        same, open_ = witness(rows.drop("bytes"), str(level))
        spans.append(same)
        store.drop(f"rows-{level - 1}", f"{level - 1}-open")
        sizes = open_.select("t1", "t2", "lo", "hi", "slices")
    store.drop(f"rows-{level}", f"{level}-open")
    out = twice.select("t1", "t2", F.lit(0).alias("start"), F.lit(-1).alias("end"))
    for part in spans:
        out = out.unionByName(part)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, starts, ends -> doc_id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(1)):
            starts, ends = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)
            row = np.repeat(np.arange(b - a), np.asarray(starts.value_lengths().fill_null(0)))
            start, end = (np.asarray(x.flatten(), dtype=np.int64) for x in (starts, ends))
            end = np.where(end < 0, offsets[row + 1], offsets[row] + end)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, offsets[row] + start, 1)
            np.add.at(step, end, -1)
            gone = np.cumsum(step)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            border = offsets[:-1][offsets[:-1] < len(data)]
            begins[border] = gone[border]
            runs = np.concatenate([[0], np.cumsum(begins)])
            kept = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
            count = lambda x: pa.array((x[offsets[1:]] - x[offsets[:-1]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), count(lost), count(runs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, least: int = LEAST, gram: int = GRAM, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove all bytes covered by a string of ``least`` bytes that starts in two places of the corpus or more.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary)."""
    store = Store(docs.sparkSession, "bytes")
    spans = repeated_bytes(docs, least, gram, bucket, text_col)
    cuts = store.put(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("cut")), "cuts")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).join(cuts.hint("merge"), ["t1", "t2"], "left")
    return keyed.select("doc_id", "text", F.col("cut.start").alias("starts"), F.col("cut.end").alias("ends")).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
