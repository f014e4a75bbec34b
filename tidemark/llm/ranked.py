"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The terms of the items of one block are patterns with a boundary at both ends, and make one automaton, which is
broadcast. Every pattern begins with a boundary and holds no other but its last, so the failure of any state is to wait
for the next boundary, and each boundary leads to the same state: the automaton is its tree of goto transitions, kept as
an open-addressed table, and all runs between two boundaries of a piece of text step through it together. A state at
which a boundary ends a term puts out the term, and the term's list of items gives the items.

Two scans of the texts. The first sums, in each task, how many documents hold each term, and the documents and terms
there are; a row for each term and task is shuffled. The second counts a document's terms again, adds up its score for
each item that holds one of them, and keeps the ``top`` best of each item in the task: an item's ranking is merged from
these, first within groups of tasks, then over the groups, so no ranking is made from more than a few rows a task. Sums
are whole numbers: in doubles while they stay below 2**53, else in 64-bit integers.

Bounds. A block of items has about ``block`` bytes of distinct terms, by hash of the item; more items make more blocks,
each with its two scans. An item is never split, so the automaton of a very long item has the size of its terms.

Null texts and texts without terms are no documents in N, are found by no item and rank nowhere. Items of one id are one
item with the terms of all its rows, a null id is an item like others, an item without terms has no rows. Repeated rows
of documents are ranked each; of equal scores the smaller id comes first, a null id last. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Store
from tidemark.llm.textscan import Words, steps

# Fixed value: what terms consist of; bytes beyond ASCII belong to them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Bytes of distinct terms of the items of one block, about.
BLOCK = 200_000
#: Bytes of text that are scored together.
STEP = 1 << 20
#: Terms of so many items are added by a matrix, others item by item.
COMMON = 4
GROUPS = 64

#: By byte: the letter or digit in lower case, 0 for a boundary.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)


class Automaton:
    """The automaton of boundary, term, boundary for all terms. State 0 waits for a boundary, state 1 is behind one."""

    def __init__(self, terms: list[bytes]):
        tree: dict[int, int] = {}
        ends = [-1, -1]
        for k, term in enumerate(terms):
            at = 1
            for c in term:
                to = tree.get(at << 8 | c)
                if to is None:
                    to = tree[at << 8 | c] = len(ends)
                    ends.append(-1)
                at = to
            ends[at] = k
        self.ends = np.array(ends, np.int32)
        bits = max(4, (2 * len(tree)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, to = np.fromiter(tree, np.int64, len(tree)), np.fromiter(tree.values(), np.int32, len(tree))
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            won = self.keys[slot] == key
            self.to[slot[won]] = to[won]
            key, to, slot = key[~won], to[~won], (slot[~won] + 1) & self.mask
        self.first = np.array([tree.get(1 << 8 | c, 0) for c in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | byte
        slot, out = self._slot(key), np.zeros(len(key), np.int32)
        seen = self.keys[slot]
        same = seen == key
        out[same] = self.to[slot[same]]
        todo = np.flatnonzero(~same & (seen >= 0))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[at]
            same = seen == key[todo]
            out[todo[same]] = self.to[at[same]]
            todo = todo[~same & (seen >= 0)]
        return out

    def scan(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs between boundaries: which are terms, and which terms."""
        at, state, k, runs, terms = np.arange(len(start)), self.first[data[start]], 1, [], []
        while len(at):
            at, state = at[state > 0], state[state > 0]
            over = size[at] == k
            term = self.ends[state[over]]
            runs.append(at[over][term >= 0])
            terms.append(term[term >= 0])
            at, state = at[~over], state[~over]
            state = self.step(state, data[start[at] + k])
            k += 1
        return np.concatenate(runs or [np.zeros(0, np.int64)]), np.concatenate(terms or [np.zeros(0, np.int32)])


def _counted(automaton: Automaton, n_terms: int, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, terms of each row, and row, term and times of what is found, in order."""
    for a, b, data, offsets in steps(column, STEP):
        folded = FOLD[data]
        words = Words(folded, offsets, folded > 0)
        run, term = automaton.scan(folded, words.start, words.end - words.start)
        found, times = np.unique(words.row[run] * n_terms + term, return_counts=True)
        yield a, np.diff(words.first), found // n_terms, found % n_terms, times


def _document_counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each term; as term -1 documents with terms, as -2 terms."""
        automaton, n_terms = shared.value
        df, n_all, l_all = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in _counted(automaton, n_terms, batch.column(0)):
                df += np.bincount(term, minlength=n_terms)
                n_all += int((n > 0).sum())
                l_all += int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]]), pa.int32()), pa.array(np.concatenate([df[held], [n_all, l_all]]), pa.int64())], ["term", "docs"])

    return count


class Best:
    """The top rows of each item so far: by score, then id, null ids last."""

    def __init__(self, items: int, top: int):
        self.items, self.top, self.least, self.kept, self.n = items, top, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if len(row):
            self.kept.append((item, scores[row, item], no_id[row], ids[row]))
            self.n += len(row)
            if self.n > 4 * self.items * self.top:
                self.rank()

    def rank(self) -> tuple[np.ndarray, ...]:
        if not self.kept:
            return (np.zeros(0, np.int64),) * 4
        item, score, no_id, ids = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        last = item[place == self.top - 1]
        self.least[last] = score[order][np.searchsorted(item[place < self.top], last, "right") - 1]
        kept = tuple(x[order] for x in (np.concatenate(x) for x in zip(*self.kept)))
        self.kept, self.n = [kept], len(order)
        return kept


def _scorer(shared, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each item in this task."""
        automaton, weights, holds, of, item_ids, n_all, l_all = shared.value
        n_terms, n_items = len(weights), len(item_ids)
        many = np.diff(holds)
        common = np.flatnonzero(many >= COMMON)
        place = np.full(n_terms, -1)
        place[common] = np.arange(len(common))
        exact = float(weights.max(initial=0)) * 1e6 * max(np.bincount(of, minlength=1).max(initial=0), 1) < 2**53
        table = np.zeros((len(common), n_items), np.float64 if exact else np.int64)
        for k, t in enumerate(common):
            table[k, of[holds[t] : holds[t + 1]]] = 1
        best = Best(n_items, top)
        for batch in batches:
            ids = batch.column(1)
            no_id, ids = np.array(ids.is_null()), np.array(ids.fill_null(0))
            for a, n, row, term, times in _counted(automaton, n_terms, batch.column(0)):
                m = np.array([50 + 50 * x * n_all // l_all for x in n.tolist()] if l_all else [0] * len(n), np.int64)
                part = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
                dense = np.zeros((len(n), len(common)), table.dtype)
                often = place[term] >= 0
                dense[row[often], place[term[often]]] = part[often]
                scores = (dense @ table).astype(np.int64)
                row, term, part = row[~often], term[~often], part[~often]
                size = many[term]
                to = of[np.repeat(holds[term] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                np.add.at(scores, (np.repeat(row, size), to), np.repeat(part, size))
                best.add(scores, ids[a : a + len(n)], no_id[a : a + len(n)])
        item, score, no_id, ids = best.rank()
        yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(item)), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return score


def _block(texts: DataFrame, rows: pa.Table, top: int) -> DataFrame:
    """The best documents of the items of one block; rows: item, term."""
    sc = texts.sparkSession.sparkContext
    items = rows["item"].combine_chunks()
    item_ids = items.unique()
    number = {x: k for k, x in enumerate(item_ids.to_pylist())}
    terms = sorted(set(rows["term"].to_pylist()))
    place = {t: k for k, t in enumerate(terms)}
    pairs = sorted((place[t], number[i]) for i, t in zip(items.to_pylist(), rows["term"].to_pylist()))
    per = Counter(t for t, _ in pairs)
    holds = np.concatenate([[0], np.cumsum([per[k] for k in range(len(terms))])]).astype(np.int64)
    automaton = Automaton([t.encode() for t in terms])
    counts = texts.mapInArrow(_document_counter(sc.broadcast((automaton, len(terms)))), "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    df = {r["term"]: r["docs"] for r in counts.collect()}  # one row a term of the block
    n_all, l_all = df.get(-1, 0), df.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
    shared = sc.broadcast((automaton, weights, holds, np.array([i for _, i in pairs], np.int64), item_ids, n_all, l_all))
    return texts.mapInArrow(_scorer(shared, top), "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item, ranks from 1."""
    store = Store(docs.sparkSession, "ranked")
    low = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = store.put(items.select(F.col(item_col).cast("long").alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct(), "terms")
    blocks = (terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // block + 1
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = dealt.filter(F.col("block") == b).select("item", "term").toArrow()
        if rows.num_rows:
            found = found.unionByName(_block(texts, rows, top))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
