"""A training corpus from raw documents, in five stages of the operators in ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's result as
Parquet into the shared folder and reads it again, so a lost executor costs no more than the tasks of the current stage.

All stages take nulls in any column, texts of any length, repeated rows and empty tables; of ``docs`` they read the columns
of ``documents`` and ignore others. The surrogates need a secret: set TESSERA_PII_KEY. Without it each session draws its
own, which is never written anywhere, so a later run gives other surrogates.
"""

from __future__ import annotations

import os
import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_duplicates, pii, quality_rules
from tessera.llm.text import marked, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every document; documents that the rules reject go, null and empty ones among them. Repeated
    rows are judged alike and all stay or go."""
    judged = quality_rules.quality_rules(docs.select(COLUMNS)).where("kept")
    return judged.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five words a shingle, similarity 0.8.

    It is the one of the smallest id. Rows that share an id are one document; the least of them by text, then by the other
    columns, stays for it. Rows without an id all stay, and documents without words link with nothing. Only rows that may
    go are shuffled with their texts.
    """
    docs = docs.select(COLUMNS)
    judged, _ = written(near_duplicates.near_duplicates(docs, shingle=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "judged")
    rows = marked(docs, "doc_id", judged.select("doc_id"), "maybe")
    asked = rows.where("maybe and doc_id is not null").select(COLUMNS)
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("m")
    stay = asked.join(judged.where("not kept").select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(least).select("doc_id", "m.*")
    return rows.where("not maybe or doc_id is null").select(COLUMNS).unionByName(stay.select(COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Rows are judged by their text alone; null and empty texts stay."""
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@lru_cache(1)
def _key() -> str:
    return os.environ.get("TESSERA_PII_KEY") or secrets.token_hex(32)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; null texts stay null, equal rows stay equal."""
    done = pii.pseudonymise(docs.select(COLUMNS), _key())
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document with the words that the mix takes of it, 0 to 3 times its size, by ``taken``. Empty
    and null texts have size 0 and are not taken."""
    return mixing.mixed(docs.select(COLUMNS), mixing.mix(docs))


STAGES = [("quality rules", quality), ("near duplicates", near_dup), ("decontamination", leaks), ("personal data", surrogates), ("source mix", mix)]

#: Near duplicates and banded alignment have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
