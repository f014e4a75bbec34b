"""Embedding near-dedup by lattice hashing.

Each of ``tables`` random projections takes the unit vector to eight dimensions, scaled by ``scale``, where the nearest
point of the E8 lattice names its cell; the vector also probes the ``probes`` neighbouring cells nearest to it (of the
lattice's 240). Two vectors meet in a cell where one lives and the other lives or probes. Equal vectors form one class
with a weight, and only classes are hashed. Inside a cell, blocks of classes are compared by cosine in double precision,
block against block, so a crowded cell becomes many tasks; a pair is counted in the first cell where the two meet and
nowhere else. Pairs are never emitted: a block yields each class's number of linked rows and one link to the smallest
vector of its group inside the block.

Vectors that are null, empty, of another length than the most, zero, or hold null or non-finite components link with
nothing and keep themselves. Rows that repeat a vec_id have links of their own, but are one node of the components; a
null vec_id links with nothing. An empty table gives an empty one.

The lattice's scale follows the number of classes (``settings``): cells grow finer as the scale's eighth power, and
tables and probes grow with it, so that a pair at the threshold is missed about once in 1 000 times or less at every
size and a cell of unrelated vectors stays small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import Store

COSINE = 0.95
SEED = 20240229
#: Up to so many classes: tables, probes and scale.
SETTINGS = ((200_000, 3, 4, 1.5), (2_000_000, 5, 8, 2.5), (50_000_000, 6, 16, 3.0), (1 << 62, 9, 32, 4.0))
#: Classes of a cell that form one block, and compared at once.
BLOCK, STRIP = 1024, 64


def settings(classes: int) -> tuple[int, int, float]:
    """Tables, probes and scale for a table of so many different vectors."""
    return next(x for most, *x in SETTINGS if classes <= most)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd, round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _name(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name for lattice points (doubled, they are small integers: eight bits each are enough for scale < 30)."""
    packed = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(7)) | ((2 * points[..., k]).astype(np.int64) & 127).astype(np.uint64)
    return ((packed << np.uint64(8)) | np.uint64(table)).view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Names of each vector's cells: vectors x tables x (1 + probes), its home first."""
    rng, shifts = np.random.default_rng(seed), neighbours()
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = scale * unit @ (rng.standard_normal((unit.shape[1], 8)) / np.sqrt(8))
        home = nearest_e8(x)
        out[:, t, 0] = _name(home, t)
        if probes:
            top = np.argpartition(-((x - home) @ shifts.T), probes - 1, axis=1)[:, :probes]
            out[:, t, 1:] = _name(home[:, None, :] + shifts[top], t)
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # so that squares of very small or large components keep their digits
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hash(dim: int, kind: str, tables: int, probes: int, scale: float, seed: int):
    """Class (two hashes), its least id, weight, vector -> the same with the vector's bytes and all its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.asarray(batch.column(4).flatten(), dtype=kind).reshape(batch.num_rows, dim)
            names = cells(_unit(raw), tables, probes, scale, seed).reshape(len(raw), -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(list(names), pa.list_(pa.int64()))], ["h1", "h2", "row", "weight", "raw", "cells"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The first cell where each pair meets; a, b: pairs x (tables * width) names."""
    out = np.zeros(len(a), np.int64)
    todo = np.ones(len(a), bool)
    for t in range(tables):
        x, y = a[:, t * width : (t + 1) * width], b[:, t * width : (t + 1) * width]
        p, q = x[:, 0], y[:, 0]
        in_p, in_q = (y == p[:, None]).any(axis=1), (x == q[:, None]).any(axis=1)
        cell = np.where(in_p & in_q, np.minimum(p, q), np.where(in_p, p, q))
        hit = todo & (in_p | in_q)
        out[hit] = cell[hit]
        todo &= ~hit
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each group of linked positions (a union of minima, repeated until still)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(cosine: float, kind: str, tables: int, width: int):
    """One pair of blocks of a cell (key: cell, block, other): linked rows counted by class and one link per linked class."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        pair = (table.column("block")[0].as_py(), table.column("other")[0].as_py())
        rows, weight, owner, home = (table.column(c).to_numpy() for c in ("row", "weight", "own", "home"))
        n = len(rows)
        unit = _unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(n, -1))
        names = np.asarray(table.column("cells").combine_chunks().flatten()).reshape(n, -1)
        left, right = np.flatnonzero(owner == pair[0]), np.flatnonzero(owner == pair[1])
        place = np.empty(n, np.int64)
        place[np.argsort(rows, kind="stable")] = np.arange(n)
        count, root = np.zeros(n, np.int64), np.arange(n)  # root: by place
        for s in range(0, len(left), STRIP):
            strip = left[s : s + STRIP]
            near = unit[strip] @ unit[right].T >= cosine - 1e-9
            near &= home[strip][:, None] | home[right][None, :]
            if pair[0] == pair[1]:
                near &= strip[:, None] < right[None, :]
            i, j = np.nonzero(near)
            i, j = strip[i], right[j]
            exact = (unit[i] * unit[j]).sum(axis=1) >= cosine
            i, j = i[exact], j[exact]
            first = _first_meeting(names[i], names[j], tables, width) == cell
            i, j = i[first], j[first]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            root = _roots(root[place[i]], root[place[j]], n)[root] if len(i) else root
        at = np.flatnonzero(count)
        return pa.table({"h1": table.column("h1").take(at), "h2": table.column("h2").take(at), "row": rows[at], "links": count[at], "to": np.sort(rows)[root[place[at]]]})

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int | None = None, scale: float | None = None, seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All vectors with their links: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    spark = vectors.sparkSession
    store = Store(spark, "lattice")
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    as_ = "array<float>" if kind == "<f4" else "array<double>"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(as_).alias("vec"))
    base = base.withColumn("vec", F.transform("vec", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)).cast(as_))  # -0.0 is 0.0
    sound = F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    good = base.filter(sound & F.col("vec_id").isNotNull())
    size = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    classes = good.filter(F.size("vec") == size.d).groupBy("vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("row"))
    classes = store.put(classes.select(*hashes, "row", "weight", "vec"), "classes")
    given = settings(classes.count())
    tables, probes, scale = tables or given[0], given[1] if probes is None else probes, scale or given[2]
    hashed = store.put(classes.mapInArrow(_hash(size.d, kind, tables, probes, scale, seed), "h1 long, h2 long, row long, weight long, raw binary, cells array<long>"), "hashed")
    width = 1 + probes
    key = ["h1", "h2"]
    visits = hashed.select(*key, F.posexplode("cells").alias("n", "cell")).select(*key, "cell", (F.col("n") % width == 0).alias("home"))
    load = store.put(visits.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0").select("cell", "n"), "load")
    met = visits.join(load, "cell").select(*key, "cell", "home", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = met.withColumn("own", F.pmod(F.xxhash64(*key, "cell"), F.col("blocks")).cast("int"))
    # each block meets itself and every other one
    pairs = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pairs = pairs.select(*key, "cell", "home", "own", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"))
    full = pairs.join(hashed, key)
    found = full.groupBy("cell", "block", "other").applyInArrow(_compare(cosine, kind, tables, width), "h1 long, h2 long, row long, links long, to long")
    found = store.put(found.groupBy(*key, "row", "to").agg(F.sum("links").alias("links")), "found")
    # a row's links: those of its class and the other rows of its class
    linked = found.groupBy(*key).agg(F.sum("links").alias("links"))
    info = classes.select(*key, "row", "weight").join(linked, key, "left").filter("weight > 1 or links is not null")
    rows = base.filter("vec_id is not null").select("vec_id", *hashes)
    rows = store.put(rows.join(store.put(info, "info"), key, "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"), "row"), "rows")
    store.drop("hashed", "load", "classes", "info")
    ties = found.select(F.col("row").alias("a"), F.col("to").alias("b")).unionByName(rows.filter("vec_id <> row").select(F.col("vec_id").alias("a"), F.col("row").alias("b")))
    groups = components(ties, "lattice-components")
    component = F.coalesce("component", "vec_id")
    out = rows.join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left").select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    alone = base.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
