"""Linking of arriving query records against a fixed pool.

The pool is indexed once. Each micro-batch only weighs its own tokens, and appends scored pairs; matches are decided over all
scores so far, so a pool record has one query whatever batch it came in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decide
from tessera.operators.blocking import Blocking, candidates, idf, index, postings, scores
from tessera.sources.tables import table


class Pool:
    """Pool records (id, country and the channels' columns) and their index."""

    def __init__(self, records: DataFrame, channels: dict[str, str], p: Blocking) -> None:
        rows = records.select("id", "country", F.lit(False).alias("is_query"), *channels.values())
        self.channels, self.p = channels, p
        self.index = index(rows, channels, p)
        self.weights = table(idf(postings(rows, channels), p), "pool-weights")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Candidates of query records; tokens that the pool does not weigh have none."""
        posts = postings(queries.select("id", "country", F.lit(True).alias("is_query"), *self.channels.values()), self.channels)
        asked = posts.join(self.weights, ["country", "channel", "tok"]).select("country", "channel", "tok", "id", "is_query", "df", "idf", F.array("idf").alias("w"))
        return candidates(scores(self.index.unionByName(asked), self.p), self.p)


def link_stream(queries: DataFrame, pool: Pool, scorer: Callable[[DataFrame, DataFrame], DataFrame], sink: str, checkpoint: str, **options):
    """Start a query that scores each micro-batch of ``queries`` and adds its pairs (q, c, p) to Parquet at ``sink``.

    ``scorer`` gets a batch's candidates and its records. A batch that is tried again writes its own folder anew, so pairs
    are never doubled.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        scorer(pool.candidates(batch), batch).select("q", "c", "p").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options.pop("options", {})).trigger(**(options or {"availableNow": True})).start()


def matches(spark: SparkSession, sink: str, threshold: float, cap: int = 15) -> DataFrame:
    """Decided pairs over every batch so far; a pair that two batches scored counts once, by its best score."""
    pairs = spark.read.parquet(sink).groupBy("q", "c").agg(F.max("p").alias("p"))
    return decide.decide(pairs, threshold, cap)
