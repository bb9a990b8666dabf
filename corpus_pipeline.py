"""The training-corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), with ``docs`` what its predecessor
returned, written as Parquet and read again; all but the last return the columns
of ``documents``. ``run`` writes between the stages to the shared folder.

Each row is a document, whatever doc_id it shares (near-dedup removes repeated rows
as it does any copies); after mixing, a document that is taken n times is n rows, in
training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import common, linededup, mixing, packing, quality, simhash
from offerlens.llm.queries import tokenizer_path
from offerlens.session import ship


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Other columns under names that no stage uses, and the names to give back."""
    own = ("doc_id", "text", "n_chars", "source")
    return docs.select(*[F.col(f"`{c}`").alias(c if c in own else f"_other{i}") for i, c in enumerate(docs.columns)]), docs.columns


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    ship(spark)
    plain, names = _apart(docs)
    return quality.kept_documents(plain).select(*plain.columns).toDF(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more share, but in their keeper; n_chars follows."""
    ship(spark)
    plain, names = _apart(docs)
    done = linededup.dedup(plain)
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*plain.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near copies connect, with the smallest doc_id: five-word shingles, Jaccard similarity 0.8 or more."""
    ship(spark)
    plain, names = _apart(docs)
    return simhash.keep_one(plain).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position."""
    ship(spark)
    plain, names = _apart(docs)
    whole = plain.select("doc_id", "source", "text", F.struct(*plain.columns).alias("_row"))
    return mixing.ordered(mixing.mix(whole, keep=["_row"])).select("_row.*").toDF(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Suffix arrays, SimHash and token ids are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
