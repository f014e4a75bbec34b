"""MinHash near-dedup with circulant signatures.

A document's set holds its distinct runs of five words (A-Z lower-cased), or all its words as one run if there are fewer.
Signatures: one random map takes each run to a place on a ring of ``ring`` places, one random permutation of the ring is
read there; coordinate k of the signature is the least value that the set meets when the permutation is shifted by k.
So two permutations make all ``bands * rows`` coordinates, and a run's values are one slice of memory.

Documents with equal sets form a class and are compared once. Classes meet in buckets (one per band). First each bucket's
smallest member is paired with all others: the pairs of all bands are made distinct, exact Jaccard on the full sets
confirms them, and components are joined; a group of copies takes about as many pairs as members. Buckets whose members
are then one component are done. In the others, members of different components are compared by their signatures, block
against block in tasks, each two where they first meet; those whose longer signatures (``PROBE`` coordinates) agree as often as a linked pair's do in
all but one of 30 000 cases (four standard deviations) are confirmed on the full sets too. So links between members that
are connected already are not looked for, and no other is left out.

With 40 bands of 5 a pair at the threshold 0.75 meets with probability 0.99998. Documents without words link with
nothing. A null id links with nothing and stays; rows with one id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import Store
from tidemark.llm.textscan import BASES, Words, mix, prefix_sums, rolling, span_hash, steps

SHINGLE = 5
#: Members of a bucket that one block holds; coordinates by which members of mixed buckets are compared.
BLOCK, PROBE = 512, 800
PERCENT = 75
BANDS, ROWS, RING, SEED = 40, 5, 1 << 20, 20240301
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ring(size: int, width: int, seed: int) -> np.ndarray:
    """The permutation, continued so that every shift is one slice: row p holds the values at p .. p + width - 1."""
    values = np.random.default_rng(seed).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: width - 1]]), width)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    words = Words(data, offsets)
    h = words.hashes(LOWER[data])
    runs, whole = rolling(h, n), prefix_sums(h, BASES[1])
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield span_hash(whole, np.array([a]), np.array([b]), BASES[1])
        else:
            yield np.zeros(0, np.uint64)


def signature(found: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The circulant signature of a set of shingle hashes."""
    at = (found >> np.uint64(7)) % np.uint64(len(shifts))
    least = np.full(shifts.shape[1], np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(at), 2048):
        np.minimum(least, shifts[at[s : s + 2048]].min(axis=0), out=least)
    return least


def _sign(n: int, bands: int, rows: int, size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = ring(size, bands * rows, seed)
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                counts, sums, sums2, keys = [], [], [], []
                for found in shingle_sets(data, offsets, n):
                    counts.append(len(found))
                    sums.append(int(found.sum(dtype=np.uint64)))
                    sums2.append(int(mix(found ^ np.uint64(BASES[0])).sum(dtype=np.uint64)))
                    if len(found):
                        keys.append(_band_keys(signature(found, shifts), bands, rows))
                    else:
                        keys.append(np.zeros(0, np.int64))
                whole = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), whole(sums), whole(sums2), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights, band = mix(np.arange(1, rows + 1, dtype=np.uint64)), mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
    parts = least.reshape(bands, rows).astype(np.uint64) + np.uint64(1)
    return mix((mix(parts) * weights).sum(axis=1, dtype=np.uint64) + band).view(np.int64)


def _sets(n: int, bands: int, rows: int, probe: int, size: int, seed: int):
    """Full sets, band keys and longer signatures (one byte a coordinate) of the documents that share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = ring(size, probe, seed)
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                found = list(shingle_sets(data, offsets, n))
                long_ = [signature(x, shifts) for x in found]
                columns = [[x.tobytes() for x in found], [_band_keys(x[: bands * rows], bands, rows).tobytes() for x in long_], [x.astype(np.uint8).tobytes() for x in long_]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "shingles", "keys", "signature"])

    return run


def _likely(least: int):
    """Two blocks of a bucket (key: bucket, band, block, other) -> pairs of different components that first meet here
    and agree in ``least`` coordinates."""

    def run(table: pa.Table) -> pa.Table:
        band, block, other = (table.column(c)[0].as_py() for c in ("band", "block", "other"))
        rep, comp, own = (table.column(c).to_numpy() for c in ("rep", "comp", "own"))
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(rep), -1)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(len(rep), -1)
        left, right = np.flatnonzero(own == block), np.flatnonzero(own == other)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left.tolist():
            j = right[(comp[right] != comp[i]) & ((right > i) | (block != other))]
            j = j[(keys[j] == keys[i]).argmax(axis=1) == band] if len(j) else j
            j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
            a.append(np.maximum(rep[j], rep[i]))
            b.append(np.minimum(rep[j], rep[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _confirm(percent: int):
    """a, b, both sets -> the pairs whose exact Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, size: int = RING, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    spark = docs.sparkSession
    store = Store(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = store.put(base.mapInArrow(_sign(n, bands, rows, size, seed), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signed")
    same = ["s1", "s2", "n_shingles"]
    classes = store.put(signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "classes")
    reps = signed.join(classes, same).filter("doc_id = rep").select("rep", F.posexplode("bands").alias("band", "bucket")).distinct()
    reps = store.put(reps, "reps")
    crowded = store.put(reps.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    members = store.put(reps.join(crowded, "bucket"), "members")
    wanted = store.put(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = store.put(base.join(wanted, "doc_id").mapInArrow(_sets(n, bands, rows, PROBE, size, seed), "doc_id long, shingles binary, keys binary, signature binary"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a")
        with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
        return store.put(with_b.select("a", "b", "of_a", "of_b").mapInArrow(_confirm(percent), "a long, b long"), name)

    centres = store.put(members.groupBy("bucket").agg(F.min("rep").alias("b")), "centres")
    stars = store.put(members.join(centres, "bucket").filter("rep > b").select(F.col("rep").alias("a"), "b").distinct(), "stars")
    links = confirmed(stars, "star-links")
    labels = components(links, "minhash-stars")
    state = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "band", "n", "rep", F.coalesce("component", "rep").alias("comp"))
    state = store.put(state, "state")
    mixed = store.put(state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi and (lo is not null)").select("bucket"), "mixed")
    # two members that are the whole bucket have been compared
    state = state.filter("n > 2").join(mixed, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    state = state.withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    state = state.select("bucket", "band", "rep", "comp", "own", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"))
    signed_state = state.join(sets.select(F.col("doc_id").alias("rep"), "keys", "signature"), "rep")
    share = percent / 100
    least = int(PROBE * (share - 4 * (share * (1 - share) / PROBE) ** 0.5))
    likely = signed_state.groupBy("bucket", "band", "block", "other").applyInArrow(_likely(least), "a long, b long")
    likely = store.put(store.put(likely, "likely-all").join(stars, ["a", "b"], "left_anti").distinct(), "likely")
    more = confirmed(likely, "more-links")
    if more.take(1):
        labels = components(links.union(more), "minhash-components")
    store.drop("reps", "crowded", "members", "wanted", "sets", "centres", "stars", "star-links", "state", "mixed", "likely-all", "likely", "more-links")
    named = signed.drop("bands").join(classes, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    out = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
