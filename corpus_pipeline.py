"""A corpus pipeline: quality rules, near-duplicates, secret scans, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage's result as Parquet in the
shared folder and reads it back for the next.

Defined cases, the same in every stage: a null text is a document without words; null doc_ids, languages and sources
are values like others; repeated rows are documents of their own until the near-duplicate stage leaves one of them;
an empty table gives an empty table with the stage's columns; further columns of documents are carried, whatever
their names (in the packing stage only doc_id is); texts of any length are read whole.

Tables that a stage keeps in the shared folder belong to its result: those that the result doesn't read go at once,
the others when a later stage is called with documents read back from that written result.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpress import scratch
from lumenpress.llm import mixing, neardup, packing, quality, secrets

#: Results of stages by their mark: the saved tables they read.
_TABLES: dict[str, list[str]] = {}
_MARK = "lumenpress.stage"


def stage(f):
    """A stage whose result is marked, in the metadata of its columns, which Parquet keeps.

    Documents that carry the mark of an earlier result come from it, and if they don't read its saved tables
    they were written since, so that the tables can go. Other results, written or not, keep theirs.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for mark in {c.metadata[_MARK] for c in docs.schema if _MARK in c.metadata}:
            _TABLES[mark] = scratch.discard(spark, _TABLES.get(mark, []), keep=docs)
        with scratch.recording() as made:
            out = f(spark, docs, sf_dir)
        mark = uuid.uuid4().hex
        _TABLES[mark] = scratch.discard(spark, made, keep=out)
        return out.select(*(F.col(f"`{c}`").alias(c, metadata={_MARK: mark}) for c in out.columns))

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the robust outlier test keep; of repeated rows all or none.

    Null and empty texts fail the base rule and go. Where a whole corpus is too small for an estimate, the base
    rule alone decides.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text", "lang", "source")
    return quality.robust_outliers(whole, carry=["doc"]).filter("kept").select("doc.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least doc_id, null last; of repeated rows one.

    Null texts are classes of their own and all stay; texts without words are classes of equal texts.
    """
    return neardup.keep_one(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars set anew; a null text stays null, with a null n_chars.

    Equal texts are marked alike.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice; null is a source of its own, and last.

    A document without words has nothing to take and comes as often as its source's whole repetitions.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source")
    mixed = mixing.mix(whole, carry=["doc"]).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


@stage
def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is one piece, the end id.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return packing.pack(docs, carry=["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_pack),
]

#: Robust estimates, connected components and seeded draws aren't expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of the tables in between only the last is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.recording() as made:
        for name, step in STAGES:
            docs = scratch.saved(step(spark, docs, sf_dir), name.replace(" ", "-"))
            made[:] = scratch.discard(spark, made, keep=docs)
    return docs
