"""Sources and sinks of record linkage: tab-separated tables, truth lists, view tables, scores, match lists, run records."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import exists, removed, renamed, said

RECORD = "entity_id string, business_name string, business_address string, country string"
#: Scores below this are not written, so thresholds below it cannot be tried afterwards.
P_FLOOR = 0.05


@dataclass(frozen=True)
class Inputs:
    """Where the tables of a challenge are: ``{side}_source{n}.tsv`` and ``{side}_ground_truth.tsv`` under one root."""

    root: str

    def sources(self, side: str, numbers: Iterable[int] = (1, 2, 3)) -> list[str]:
        return [f"{self.root}/{side}_source{n}.tsv" for n in numbers]

    def truth(self, side: str) -> str:
        return f"{self.root}/{side}_ground_truth.tsv"

    def missing(self, spark: SparkSession, side: str) -> list[str]:
        """Expected files that are not there."""
        return [p for p in [*self.sources(side), self.truth(side)] if not exists(spark, p)]


def unzipped(archive: str, to: str) -> list[str]:
    """Extract a zip archive of inputs, without the hidden folders that some systems add; its tab-separated files."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.startswith("__MACOSX") and not n.endswith("/")]
        z.extractall(to, names)
    return sorted(str(Path(to) / n) for n in names if n.endswith(".tsv"))


def read_tsv(spark: SparkSession, path: str | list[str], schema: str = RECORD, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text with a header; quotes and backslashes are literal, empty fields are empty strings. Only ``columns``
    are parsed, if given."""
    df = spark.read.options(sep="\t", header=True, quote="", escape="").schema(schema).csv(path)
    return (df.select(columns) if columns else df).na.fill("")


def read_records(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Records with ``src``, the source in their id, and ``row_idx``, which orders them as the files do."""
    df = read_tsv(spark, path, columns=columns)
    df = df.withColumn("row_idx", F.monotonically_increasing_id())
    if "country" in df.columns:
        df = df.withColumn("country", F.trim("country"))
    return df.withColumn("src", F.substring_index("entity_id", "-", 1)) if "entity_id" in df.columns else df


def read_queries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(q, country, row_idx): ids and labels in input order."""
    return read_records(spark, path, ["entity_id", "country"]).select(F.col("entity_id").alias("q"), "country", "row_idx")


def read_truth(spark: SparkSession, path: str | list[str], keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries, pairs): every listed query, and its (q, c) pairs; ``keep`` (q) restricts both."""
    df = read_tsv(spark, path, "q string, ids string").withColumn("q", F.trim("q"))
    df = df.join(keep.select("q"), "q", "left_semi") if keep is not None else df
    pairs = df.select("q", F.explode(F.split("ids", ",")).alias("c")).select("q", F.trim("c").alias("c")).where("c <> ''")
    return df.select("q"), pairs


def merged_truth(*truths: DataFrame) -> DataFrame:
    """Truth pairs (q, c) of several tables; of a query that several list, the last table's pairs count."""
    out = None
    for k, t in enumerate(truths):
        part = t.select("q", "c", F.lit(k).alias("k"))
        out = part if out is None else out.unionByName(part)
    last = out.groupBy("q").agg(F.max("k").alias("k"))
    return out.join(last, ["q", "k"], "left_semi").select("q", "c").distinct()


def count_rows(spark: SparkSession, path: str) -> int:
    return max(0, spark.read.text(path).count() - 1)


def labels_in(*tables: DataFrame) -> DataFrame:
    """(country): the distinct labels of several tables, in order."""
    out = tables[0].select("country")
    for t in tables[1:]:
        out = out.union(t.select("country"))
    return out.distinct().orderBy("country")


def write_views(views: DataFrame, root: str, settings: dict, rows: int) -> str:
    """Write a view table once for each set of settings, by country; its path.

    The table is written beside its place, counted, and moved there, so a reader finds it whole or not at all. A count other
    than ``rows`` is an error. A table that is there already is kept.
    """
    spark, path = views.sparkSession, f"{root}/{version(settings)}"
    if exists(spark, path):
        return path
    part = f"{path}.part"
    removed(spark, part)
    views.write.partitionBy("country").parquet(part)
    got = spark.read.schema(views.schema).parquet(part).count()
    if got != rows:
        removed(spark, part)
        raise ValueError(f"{got} rows written of {rows}")
    renamed(spark, part, path)
    return path


def read_views(spark: SparkSession, path: str, columns: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """Views of some countries: other countries' folders and other columns are never read."""
    df = spark.read.parquet(path)
    df = df.where(F.col("country").isin(*countries)) if countries is not None else df
    return df.select(columns) if columns else df


def looked_up(views: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """(id, columns) of the few records that ``ids`` (id) lists."""
    return views.select("id", *columns).join(ids.select("id").distinct(), "id", "left_semi")


def write_scores(pairs: DataFrame, path: str) -> None:
    pairs.where(F.col("p") >= P_FLOOR).select("country", "q", "c", F.col("p").cast("float").alias("p")).write.mode("overwrite").partitionBy("country").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("q string, c string, p float, country string").parquet(path)


def write_lists(lists: DataFrame, path: str, order: str | None = None) -> None:
    """One tab-separated row a query, empty lists too; in the order of a column that is not written, if named."""
    out = lists.orderBy(order).drop(order) if order else lists
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", escape="").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_run(spark: SparkSession, path: str, facts: dict) -> None:
    """What a run was and found, as JSON."""
    said(spark, path, json.dumps(facts, sort_keys=True, default=str, indent=1))


def version(settings: dict) -> str:
    """Name of a view table made with these settings; other settings give another name."""
    return "views_" + hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:8]


def violations(matches: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of counts: queries missing, unknown or listed twice, matches outside candidates, pool records used twice.

    ``matches`` (q, c) has a row with null c for a query without any.
    """
    listed = matches.select("q").distinct()
    some = matches.where("c is not null").select("q", "c")
    parts = {
        "missing": queries.select("q").join(listed, "q", "left_anti"),
        "unknown": listed.join(queries.select("q"), "q", "left_anti"),
        "repeated": queries.groupBy("q").count().where("count > 1"),
        "outside": some.join(candidates.select("q", "c"), ["q", "c"], "left_anti"),
        "used_twice": some.groupBy("c").count().where("count > 1"),
    }
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def validated(matches: DataFrame, candidates: DataFrame, queries: DataFrame) -> dict[str, int]:
    return {r["check"]: r["n"] for r in violations(matches, candidates, queries).collect()}
