"""Stages of the pipeline against what their operators say, each on the stage before."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.private import private_spans
from tidemark.llm.store import Store


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store, kept = Store(spark, "test"), [docs]
    for name, stage in P.STAGES:
        kept.append(store.put(stage(spark, kept[-1], sf_dir), name.replace(" ", "-")))
    for before, after in zip(kept[:4], kept[1:5]):
        assert after.columns == before.columns
    good, single, clean, mixed, packed = kept[1:]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.filter("quality = 1").count() <= 0.02 * docs.count()
    assert near_duplicates(single).filter("not kept").count() == 0
    assert single.count() == near_duplicates(good).filter("kept").count()
    assert private_spans(clean).select(F.explode("pii_spans").alias("s")).filter("s.base").count() == 0
    assert clean.count() == single.count() and mixed.join(clean, "doc_id", "left_anti").count() == 0
    assert packed.agg(F.sum("length")).first()[0] == mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_kept int, mix_copies string, pii_spans int, kept string, size int, doc string, row long"


def row(i, text, source="s"):
    return (i, text, None, source, None if text is None else len(text), 0, "m", 1, "k", 5, "d", 9)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, null and empty texts, repeated rows, one very long text, clashing names."""
    say = lambda seed, n: " ".join("w%d" % k for k in np.random.default_rng(seed).integers(0, 4000, n))
    rows = [row(1, say(1, 60)), row(1, say(1, 60)), row(2, None), row(3, ""), row(None, say(2, 30)), row(None, None, None), row(4, say(3, 20000), None), row(5, "mail a@b.org now " + say(4, 40)), row(6, say(1, 60))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_awkward_rows(spark, sf_dir, awkward, k):
    name, stage = P.STAGES[k]
    out = Store(spark, "awkward").put(stage(spark, awkward, sf_dir), name.replace(" ", "-"))
    empty = stage(spark, awkward.limit(0), sf_dir)
    assert empty.count() == 0
    if k < 4:
        assert out.columns == empty.columns == awkward.columns and out.schema.simpleString() == awkward.schema.simpleString()
    have = collections.Counter(r.doc_id for r in out.collect())
    if name == "near duplicates":
        assert have == {1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1}
    if name == "personal data":
        assert sum(have.values()) == 9 and [r.text[:16] for r in out.filter("doc_id = 5").collect()] == ["mail [EMAIL] now"]
    if name == "mixture":
        assert 2 not in have and 3 not in have and have[None] <= 3
    if name == "packing":
        words = sum(len((r.text or "").split()) for r in awkward.collect())
        assert out.agg(F.sum("length")).first()[0] == words


def test_near_dedup_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in docs.collect():
        w = (r.text or "").translate(low).replace("\x0b", " ").split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    got = {r.doc_id for r in P.near_dedup(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == {i for i in ids if root[i] == i}
