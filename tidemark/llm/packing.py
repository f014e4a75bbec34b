"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of the largest capacity at most. Pieces are dealt by hash into shards of about ``shard``
pieces (their number follows the input, so no task grows), and each shard is packed by itself: longest piece first, into
the open bin that it leaves least room in. If none has room, a bin opens in the capacity whose cost per token that it
can still be filled with (by this piece and all that follow) is least, the larger one among equals; a bin of capacity c
costs ``c ** exponent + overhead``. At the end each bin is downsized to the least capacity that holds its contents.

Documents without words, null texts included, yield no piece. Null and repeated ids are packed like others and dealt out
like others: rows of one id and size, which give the same pieces, are numbered, so that they do not fill one shard. Shard
and order follow id, size, number and piece alone, so other files or another order of rows give the same bins. Other
columns are not read. An empty table gives an empty one. Returns one row per piece: doc_id, piece, start, length, bin_id,
offset, capacity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.mixing import WORD
from tidemark.llm.store import PARTS, Store, numbered

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, EXPONENT, SHARD = 16.0, 1.05, 4096


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: float, exponent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final capacity of each piece; lengths in falling order, none above the largest capacity."""
    sizes = sorted(capacities)
    cost = {c: c**exponent + overhead for c in sizes}
    rest = int(lengths.sum())
    room: dict[int, list[int]] = {}  # open bins by the room that they have left
    mask = 0  # bit r is set if some bin has room r
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: (cost[c] / min(c, rest), -c))
            b, r = len(used), c
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        rest -= n
        if r > n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    final = np.array([next(c for c in sizes if c >= u) for u in used], np.int64)
    return bins, offsets, final[bins] if len(bins) else bins


def _pack(capacities: tuple[int, ...], overhead: float, exponent: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("size", "ascending"), ("number", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = best_fit(table.column("length").to_numpy(), capacities, overhead, exponent)
        shard = table.column("shard")[0].as_py()
        return pa.table({**{c: table.column(c) for c in ("doc_id", "piece", "start", "length")}, "bin_id": (shard << 24) + bins, "offset": offsets, "capacity": capacity})

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, exponent: float = EXPONENT, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Pack by the number of words, or by ``length_col`` where the caller has counted tokens."""
    most = max(capacities)
    length = F.col(length_col) if length_col else F.regexp_count(F.col(text_col), F.lit(WORD))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("size")).filter("size > 0")
    sized = sized.withColumn("row", F.monotonically_increasing_id())  # written below, so it does not change any more
    store = Store(docs.sparkSession, "packing")
    sized = store.put(sized.withColumns({"whole": F.xxhash64("doc_id", "size"), "part": F.pmod(F.xxhash64("row"), F.lit(PARTS))}), "sized")
    many = sized.groupBy("whole").count().filter("count > 1").select("whole")
    numbers = numbered(store.put(sized.select("row", "whole", "part").join(many, "whole", "left_semi"), "many"))
    sized = sized.join(store.put(numbers.select("row", "number"), "numbers"), "row", "left").withColumn("number", F.coalesce("number", F.lit(0)))
    pieces = sized.select("doc_id", "size", "number", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {most}"))).alias("piece"))
    pieces = pieces.select("doc_id", "size", "number", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("size") - F.col("piece") * most).alias("length"))
    count = sized.agg(F.sum(F.expr(f"(size - 1) div {most} + 1"))).first()[0] or 0
    shards = max(1, -(-count // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "number", "piece"), F.lit(shards)))
    schema = "doc_id long, piece long, start long, length long, bin_id long, offset long, capacity long"
    return dealt.groupBy("shard").applyInArrow(_pack(tuple(capacities), overhead, exponent), schema)
