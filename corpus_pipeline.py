"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cotraining import quality_scores
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack
from tidemark.llm.private import private_spans, redact
from tidemark.llm.store import Store

#: Columns of documents that operators read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the others as one struct, so that no name of theirs can clash."""
    others = [f"`{c}`" for c in docs.columns if c not in READ]
    return docs.select(*[c for c in READ if c in docs.columns], (F.struct(*others) if others else F.lit(0)).alias("rest"))


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c if c in READ else f"rest.`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Null ids and texts are judged like others; without labels all
    stay; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _unpacked(quality_scores(_packed(docs), labels).filter("q_kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Rows that repeat an id and were kept all stay, rows with a
    null id and documents without words too."""
    kept = Store(spark, "kept").put(near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct(), "ids")
    alone = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(alone)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and the recorded length follows; null texts stay null."""
    out = redact(private_spans(_packed(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return _unpacked(out, docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it; documents without words are never taken."""
    mixed = mix_sources(_packed(docs)).filter("mix_copies > 0")
    return _unpacked(mixed.withColumn("mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row per piece of a document with its bin, place and the bin's length. No words: no piece."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("personal data", personal_data), ("mixture", mixture), ("packing", packing)]

#: The classifier, the signatures and the packing are no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
