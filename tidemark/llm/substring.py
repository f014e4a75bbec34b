"""Substring dedup on words: a De Bruijn graph whose edges are runs of k words.

1. Anchors. Every window of ``k`` words holds a chosen run of ``anchor`` words (its minimiser); equal windows choose
   the same one, so a window can repeat only if its anchor does. Grouping the anchors (about a quarter of the words)
   finds those that occur in two documents; a join marks where they stand.
2. Edges. Windows around such anchors are the graph's edges, named by a 64-bit hash of their words, with the windows
   before and after as neighbours. One grouping gives each edge its source coordinate (smallest document, then
   position) and whether it branches.
3. Compaction. Edges that follow one another at their source without a branch form one path; joined back to their
   occurrences, they become long spans (document, start, length, source document, source start).
4. Verification. The words of each span and of its source coordinates are compared by SHA-256; only equal ones count.

Exact copies of a whole text are set aside first: each but the first is covered wholly. Rows with a null id are
never a source and lose nothing; a null text has no words. Several rows with one id are never sources to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Store
from tidemark.llm.textscan import BASES, Words, minimizers, mix, rolling, steps

K = 13
ANCHOR = 6


def _windows(words: Words, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the anchors' places; the first window of each; which windows lie in one document."""
    h = words.hashes()
    place, first = minimizers(rolling(h, anchor), k - anchor + 1)
    inside = words.row[: max(0, len(h) - k + 1)] == words.row[k - 1 :]
    return h, place, first, inside


def _anchors(k: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in steps(batch.column(1)):
                words = Words(data, offsets)
                h, place, first, inside = _windows(words, k, anchor)
                if not len(place):
                    continue
                place = place[np.add.reduceat(inside.astype(np.int64), first) > 0]
                row = words.row[place]
                grams = rolling(h, anchor)[place].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(grams), pa.array((place - words.first[row]).astype(np.int32))], ["doc_id", "gram", "pos"])

    return run


def _edges(k: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marks = batch.column(3)
            for a, b, data, offsets in steps(batch.column(2)):
                words = Words(data, offsets)
                h, place, first, inside = _windows(words, k, anchor)
                if not len(place):
                    continue
                part = marks.slice(a, b - a)
                at = np.asarray(part.flatten(), dtype=np.int64)
                row = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                at += words.first[row]
                marked = np.zeros(len(h) + 1, bool)
                marked[at[at < len(h)]] = True
                chosen = np.repeat(place, np.diff(np.append(first, len(inside))))
                start = np.flatnonzero(marked[chosen] & inside)
                if not len(start):
                    continue
                edge = rolling(h, k)
                row = words.row[start]
                n = len(edge)
                after = np.where((start + 1 < n) & (row == words.row[np.minimum(start + k, len(h) - 1)]) & (start + k < len(h)), edge[np.minimum(start + 1, n - 1)], np.uint64(0))
                before = np.where(start > words.first[row], edge[np.maximum(start - 1, 0)], np.uint64(0))
                ends = ((after >> np.uint64(32)) << np.uint64(32)) | (before >> np.uint64(32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge[start].view(np.int64)), pa.array(ids[a + row]), pa.array(keys[a + row]), pa.array((start - words.first[row]).astype(np.int32)), pa.array(ends.view(np.int64))],
                    ["edge", "doc_id", "tkey", "pos", "ends"],
                )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the asked-for runs of words: doc_id, tkey, text, starts, lengths."""
    for batch in batches:
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a, b, data, offsets in steps(batch.column(2)):
            words, raw = Words(data, offsets), data.tobytes()
            starts, lengths = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
            row = np.repeat(np.arange(b - a), np.asarray(starts.value_lengths()))
            start, length = (np.asarray(x.flatten(), dtype=np.int64) for x in (starts, lengths))
            fits = words.first[row] + start + length <= words.first[row + 1]
            row, start, length = row[fits], start[fits], length[fits]
            out = []
            for at, n in zip(words.first[row] + start, length):
                out.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(words.start[at : at + n], words.end[at : at + n])])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(keys[a + row]), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(out, pa.binary())], ["doc_id", "tkey", "start", "length", "digest"])


def repeated_spans(docs: DataFrame, k: int = K, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words covered by a window of k words that also starts in a document with a smaller id: doc_id, tkey
    (xxhash64 of the text), start, length (-1: the whole text), src_doc, src_start."""
    spark = docs.sparkSession
    store = Store(spark, "substring")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    keyed = store.put(base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("tkey")), "keys")
    classes = store.put(keyed.groupBy("sha").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last")).filter("src_doc < last").drop("last"), "classes")
    copies = store.put(keyed.join(classes, "sha").filter("doc_id > src_doc").select("doc_id", "tkey", "src_doc").distinct(), "copies")
    store.drop("keys", "classes")

    firsts = base.withColumn("tkey", F.xxhash64("text")).join(copies.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_anti").select("doc_id", "text")
    anchors = store.put(firsts.mapInArrow(_anchors(k, anchor), "doc_id long, gram long, pos int"), "anchors")
    shared = store.put(anchors.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"), "shared")
    marks = store.put(anchors.join(shared, "gram", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("marks")), "marks")
    store.drop("anchors", "shared")

    text = base.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    edges = store.put(text.join(marks, "doc_id").mapInArrow(_edges(k, anchor), "edge long, doc_id long, tkey long, pos int, ends long"), "edges")
    store.drop("marks")
    # several rows of one id share the id as source: the coordinate names the text as well
    graph = edges.groupBy("edge").agg(
        F.min(F.struct("doc_id", "tkey", "pos")).alias("src"), F.max("doc_id").alias("last"), F.bit_and("ends").alias("all_"), F.bit_or("ends").alias("any_")
    ).filter("src.doc_id < last")
    high, low = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    graph = store.put(
        graph.select("edge", F.col("src.doc_id").alias("src_doc"), F.col("src.tkey").alias("src_tkey"), F.col("src.pos").alias("src_pos"), (high("all_") != high("any_")).alias("forks"), (low("all_") != low("any_")).alias("joins")), "graph"
    )
    at_source = Window.partitionBy("src_doc", "src_tkey").orderBy("src_pos")
    new_path = (F.lag("src_pos", 1, -9).over(at_source) != F.col("src_pos") - 1) | F.lag("forks", 1, True).over(at_source) | F.col("joins")
    paths = graph.withColumn("head", F.when(new_path, F.col("src_pos"))).withColumn("path", F.last("head", True).over(at_source)).select("edge", "src_doc", "src_tkey", "src_pos", "path")
    paths = store.put(paths, "paths")
    seen = edges.join(paths, "edge").filter("doc_id > src_doc").drop("edge", "ends")
    in_doc = Window.partitionBy("doc_id", "tkey").orderBy("pos")
    same = (F.lag("pos").over(in_doc) == F.col("pos") - 1) & (F.lag("src_doc").over(in_doc) == F.col("src_doc")) & (F.lag("src_tkey").over(in_doc) == F.col("src_tkey")) & (F.lag("path").over(in_doc) == F.col("path")) & (F.lag("src_pos").over(in_doc) == F.col("src_pos") - 1)
    seen = seen.withColumn("head", F.when(~F.coalesce(same, F.lit(False)), F.col("pos"))).withColumn("start", F.last("head", True).over(in_doc))
    spans = seen.groupBy("doc_id", "tkey", "start").agg((F.count("*") + (k - 1)).cast("int").alias("length"), F.first("src_doc").alias("src_doc"), F.first("src_tkey").alias("src_tkey"), F.min("src_pos").alias("src_start"))
    spans = store.put(spans, "spans")
    store.drop("edges", "graph", "paths")

    asked = spans.select("doc_id", "tkey", "start", "length").union(spans.select("src_doc", "src_tkey", "src_start", "length")).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "length")).alias("asked"))
    asked = store.put(asked.select("doc_id", "tkey", F.col("asked.start").alias("starts"), F.col("asked.length").alias("lengths")), "asked")
    digests = store.put(text.join(asked, ["doc_id", "tkey"]).mapInArrow(_digests, "doc_id long, tkey long, start int, length int, digest binary").distinct(), "digests")
    store.drop("asked")
    theirs = digests.select(F.col("doc_id").alias("src_doc"), F.col("tkey").alias("src_tkey"), F.col("start").alias("src_start"), "length", F.col("digest").alias("src_digest"))
    verified = spans.join(digests, ["doc_id", "tkey", "start", "length"]).join(theirs, ["src_doc", "src_tkey", "src_start", "length"]).filter("digest = src_digest")
    whole = copies.select("doc_id", "tkey", F.lit(0).alias("start"), F.lit(-1).alias("length"), "src_doc", F.lit(0).alias("src_start"))
    return verified.select("doc_id", "tkey", "start", "length", "src_doc", "src_start").unionByName(whole)


def _cut(k: int):
    """doc_id, text, starts, lengths -> doc_id, n_words, n_removed, kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                words, raw = Words(data, offsets), data.tobytes()
                starts, lengths = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.asarray(starts.value_lengths().fill_null(0)))
                start, length = (np.asarray(x.flatten(), dtype=np.int64) for x in (starts, lengths))
                n = np.diff(words.first)
                length = np.where(length < 0, np.where(n[row] >= k, n[row], 0), length)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, words.first[row] + start, 1)
                np.add.at(step, words.first[row] + start + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                texts = []
                for r in range(b - a):
                    keep = words.first[r] + np.flatnonzero(~gone[words.first[r] : words.first[r + 1]])
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(lost[words.first[1:]] - lost[words.first[:-1]]), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, k: int = K, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words that a run of k words shares with a document of smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spans = repeated_spans(docs, k, anchor, id_col, text_col)
    cuts = Store(docs.sparkSession, "cuts").put(spans.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "length")).alias("cut")), "cuts")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = base.withColumn("tkey", F.xxhash64("text")).join(cuts, ["doc_id", "tkey"], "left")
    return joined.select("doc_id", "text", F.col("cut.start").alias("starts"), F.col("cut.length").alias("lengths")).mapInArrow(_cut(k), "doc_id long, n_words long, n_removed long, kept_text string")
