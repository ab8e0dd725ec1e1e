"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Each stage works on every row its predecessor kept; all but the last return the columns of documents, whatever
else these are called.  Null and empty texts go in the first stage; an empty table passes through all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import fresh_folder
from starloom.llm.contamination import find_contamination
from starloom.llm.language import UNKNOWN, identify, learn
from starloom.llm.packing import pack_documents
from starloom.llm.simhash import near_duplicates, one_of_each
from starloom.llm.substring import dedup_substrings

#: Tokenizer files and other models are outside of SQL's reach.
ORACLE_SQL = None


def shielded(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list[Column]]:
    """(documents whose other columns bear names that no operator has, how to get all columns back)."""
    names = {c: c if c in used else f"_carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, or no n-gram of any language learned from the table."""
    shield, columns = shielded(docs, ["doc_id", "text", "lang"])
    found = identify(shield, learn(shield))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    shield, columns = shielded(docs, ["doc_id", "text"])
    return one_of_each(near_duplicates(shield, shingle=4, distance=4)).select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand more than once go; texts without such stay as they are."""
    shield, columns = shielded(docs, ["doc_id", "text", "n_chars"])
    found = dedup_substrings(shield, window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*[changed[c].alias(c) if c in changed else column for c, column in zip(docs.columns, columns, strict=True)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    shield, columns = shielded(docs, ["doc_id", "text"])
    found = find_contamination(shield, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return found.where("NOT contaminated").select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens, their pieces with the ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end=1)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
