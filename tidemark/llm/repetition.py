"""Quality rules with suffix-array repetition.

The words of each text (many texts at once) are put in suffix order by prefix doubling, with one rank table that each
round renews. Neighbours in that order give longest common prefixes, found by halving steps over polynomial hashes with
two random bases modulo two primes, so memory is a few arrays of the text's words however repetitive it is. The longer
of its two is how far the string at a position repeats in its own text. Repeats that the position before does not
contain are maximal; the spans of those of at least ``window`` words are united. A text fails if it has fewer than ``least_words`` words, if the united spans
cover more than ``covered`` percent, or if its longest repeat has more than ``longest_words`` words and more than
``longest`` percent of the text.

Counts, all over whole texts: words, code points in words, symbols, repeated lines with a word, words in repeated
windows. A null text is empty and fails. Ids are carried as they are, nulls and repeats included; other columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import SPACE, Words, steps

#: Fixed random bases of the hashes.
BASES = (1103515245, 1664525013)
WINDOW, LEAST_WORDS, COVERED, LONGEST_WORDS, LONGEST = 8, 20, 30, 64, 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


#: Fixed primes below 2 ** 31; products of two residues fit in 63 bits.
PRIMES = (2147483647, 2147483629)


def _residues(ids: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and prefix sums of ids * power, both modulo the prime."""
    n = len(ids)
    power = np.ones(n + 1, np.int64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        power[have : have + more] = power[:more] * (int(power[have - 1]) * base % prime) % prime
        have += more
    sums = np.zeros(n + 1, np.int64)
    # fewer than 2 ** 32 residues below 2 ** 31 are summed without overflow
    np.cumsum((ids + 1) % prime * power[:n] % prime, out=sums[1:])
    return power, sums % prime


def repeats(word: np.ndarray, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """At each position, the length of the longest run of words from there that also starts elsewhere in its text.

    word: hashes, row: text of each word, ends: position after that text's last word."""
    n = len(word)
    if n < 2:
        return np.zeros(n, np.int64)
    _, ids = np.unique(word, return_inverse=True)
    key = row * np.int64(ids.max() + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), -1
    one, h = rank.astype(np.int32), 1
    # a position within h of its text's end has nothing more: it sorts first and ties with nothing
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        beyond = at + h >= ends[at]
        key = (rank[at] << np.int64(32)) | np.where(beyond, 0, rank[np.where(beyond, n, at + h)] + 1)
        by = np.argsort(key, kind="stable")
        order[tied], key, beyond = at[by], key[by], beyond[by]
        # a text's end after exactly the same words happens once per text and length, so such keys are single
        fresh = np.append(True, key[1:] != key[:-1])
        new[tied] |= fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2
    del rank
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    open_ = np.flatnonzero(one[a] == one[b])
    a, b = a[open_], b[open_]
    first, gap = np.minimum(a, b), np.abs(a - b)
    found = np.ones(len(open_), np.int64)
    tables = [(prime, *_residues(ids, prime, base)) for prime, base in zip(PRIMES, BASES)]
    step = h // 2
    while step and len(open_):  # no two suffixes agree in h words
        ok = np.flatnonzero((a + found + step <= ends[a]) & (b + found + step <= ends[b]))
        for prime, power, sums in tables:  # [first, first + length) against the same, shifted by gap
            x, y, length = first[ok], first[ok] + gap[ok], found[ok] + step
            near, far = (sums[x + length] - sums[x]) % prime, (sums[y + length] - sums[y]) % prime
            ok = ok[near * power[gap[ok]] % prime == far]
        found[ok] += step
        step //= 2
    common[open_] = found
    out = np.zeros(n, np.int64)
    np.maximum.at(out, order[:-1], common)
    np.maximum.at(out, order[1:], common)
    return out


def _measure(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                words = Words(data, offsets)
                first = words.first
                n = np.diff(first)
                length = repeats(words.hashes(), words.row, first[1:][words.row])
                # maximal to the left: the position before has no repeat that contains this one
                before = np.concatenate([[0], length[:-1]])
                inside = np.concatenate([[False], words.row[1:] == words.row[:-1]]) if len(words) else np.zeros(0, bool)
                start = np.flatnonzero((length >= window) & ~(inside & (before == length + 1)))
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + length[start], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
                longest = np.zeros(b - a, np.int64)
                np.maximum.at(longest, words.row, length)
                count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[offsets[1:]] - c[offsets[:-1]]
                chars = count(~SPACE[data] & ((data & 0xC0) != 0x80))
                lines = []
                raw = data.tobytes()
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    solid = [x for x in raw[s:e].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                    lines.append(len(solid) - len(set(solid)))
                values = (n, chars, count(SYMBOL[data]), np.array(lines, np.int64), covered[first[1:]] - covered[first[:-1]], longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(v.astype(np.int64)) for v in values]], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def quality_rules(docs: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, covered: int = COVERED, longest_words: int = LONGEST_WORDS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, longest_repeat (words), base_failed, kept."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.mapInArrow(_measure(window), SCHEMA)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > covered * F.col("n_words"))
    verdict = ~((F.col("longest_repeat") > longest_words) & (100 * F.col("longest_repeat") > longest * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
