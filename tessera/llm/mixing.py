"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled anew for each epoch, form one stream of words that is cut into blocks of ``block``
words, or fewer if the smallest target asks for it. Slot n of the mix takes the golden-ratio point frac(n / phi); the point falls into one source's share of the
cumulative targets, and the k-th slot of a source takes block k of its stream. Prefix sums over a source's documents are
taken within hash ranges of its shuffled order and joined with the ranges' offsets, so no task holds a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.text import written

#: frac(n / phi) in 64-bit fixed point is n * GOLDEN modulo 2^64.
GOLDEN = 11400714819323198485
#: Slots that one task schedules at a time.
CHUNK_SLOTS = 1 << 16
#: Documents of one hash range of a shuffled source, about.
RANGE_ROWS = 2_000
#: A source's target should span so many blocks; the few slots that its points may stray are then a smaller part of it.
BLOCKS = 7
#: Blocks are not cut smaller than this many slots need.
MOST_SLOTS = 1 << 25
#: Up to so many sources are planned by the driver; more are planned by the executors, with the same result.
MAX_SOURCES = 100_000
#: Low bits of a point that a range of the schedule spans where sources are looked up by a join.
RANGE_BITS = 12


@dataclass(frozen=True)
class Source:
    """One source: its position in code-point order, name, words, documents, target and the slots it got."""

    at: int
    name: str | None
    size: int
    rows: int
    target: float
    slots: int = 0


@dataclass(frozen=True)
class Mix:
    """``schedule``: (slot, source_at, block, id, copy, epoch, start, stop): words start..stop of a document, by slot.

    ``facts`` has a row for each source: (source_at, source, s_size, s_target, slots).
    """

    facts: DataFrame
    docs: DataFrame
    schedule: DataFrame

    @property
    def sources(self) -> list[Source]:
        """The sources as a list, for mixes of few."""
        return [Source(r["source_at"], r["source"], r["s_size"], r["rows"], r["s_target"], r["slots"]) for r in self.facts.orderBy("source_at").collect()]


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[ \t-\r]+"))).otherwise(0).cast("long")


def fill_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of ``sum(sizes)`` by weight; none above ``cap`` times its size, the excess reshared by weight."""
    total, order = float(sum(sizes)), sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), total, float(sum(weights))
    for k, i in enumerate(order):
        if cap * sizes[i] >= left / weight * weights[i]:
            for j in order[k:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = float(cap * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def fitting(targets: list[float], block: int) -> int:
    """``block``, or fewer words, so that the smallest positive target spans BLOCKS of them, within MOST_SLOTS slots."""
    least = min((t for t in targets if t > 0), default=float(block * BLOCKS))
    return min(block, max(1, math.ceil(sum(targets) / MOST_SLOTS), int(least / BLOCKS)))


def thresholds(targets: list[float]) -> np.ndarray:
    """Upper ends of the sources' shares of [0, 2^32); the last one is 2^32."""
    total, run, out = sum(targets), 0.0, []
    for t in targets:
        run += t
        out.append(min(math.floor(run / total * 4294967296.0), 2**32) if total else 0)
    if out:
        last = max((i for i, t in enumerate(targets) if t > 0), default=0)
        out[last:] = [2**32] * (len(out) - last)
    return np.array(out, np.int64)


def _points(chunk: int, slots: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(chunk * CHUNK_SLOTS, min((chunk + 1) * CHUNK_SLOTS, slots), dtype=np.uint64)
    with np.errstate(over="ignore"):
        point = ((n * np.uint64(GOLDEN)) >> np.uint64(32)).astype(np.int64)
    return n.astype(np.int64), np.searchsorted(ends, point, "right")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, block: int = 256, seed: str = "mix") -> Mix:
    """Schedule a mix of all documents.

    Sources stand in code-point order, null last, and weigh ``weights`` in turn. The mix has as many words as the
    documents; a target stops at ``cap`` times its source's words. A document is taken at most ``cap`` times. Rows that
    agree in id, source and size are copies 1, 2, ... and mixed as documents of their own, null ids too. Empty documents
    are never scheduled. An empty table gives an empty schedule. The same input gives the same schedule. Other columns are
    ignored, whatever their names; texts may be of any length, and there may be any number of sources. A source's taken
    words come within a few blocks of its target: blocks are cut small enough for the smallest one, but not below what
    2^25 slots allow, so a target of less than a block may get none or one.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    units, _ = written(base.groupBy("id", "source", "size").count(), "mix-sizes")  # texts are read once
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("words"), F.sum("count").alias("rows"))
    few = found.limit(MAX_SOURCES + 1).collect()
    plan = _planned(spark, few, weights, cap, block) if len(few) <= MAX_SOURCES else _planned_apart(written(found, "mix-sources")[0], weights, cap, block)
    facts, placed, total, block = plan
    placed = placed.select("slot", "source_at", "block")
    bound = F.broadcast(facts) if len(few) <= MAX_SOURCES else facts
    docs_at = units.join(bound.withColumnRenamed("source", "s_name"), F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name", "rows")
    end = F.when(F.col("s_size") > 0, F.least(F.col("slots") * block, cap * F.col("s_size"))).otherwise(0)
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.lit(1.0), F.col("n_rows") / RANGE_ROWS)) / math.log(16))).cast("int")
    docs_at = docs_at.withColumn("s_end", end.cast("long")).withColumn("epochs", F.when(F.col("s_size") > 0, F.greatest(F.lit(1), F.ceil(F.col("s_end") / F.col("s_size")))).otherwise(1).cast("long")).withColumn("digits", digits)
    docs_at = docs_at.withColumn("copy", F.explode(F.expr("sequence(1L, count)"))).drop("count")
    full = docs_at.where(F.col("size") > 0).withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1)")))
    full = full.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "epoch", "id", "copy")))
    full = full.withColumn("range", F.substring("h", F.lit(1), F.col("digits")))
    sums = full.groupBy("source_at", "epoch", "range").agg(F.sum("size").alias("n"))
    offs = sums.select("source_at", "epoch", "range", F.coalesce(F.sum("n").over(W.partitionBy("source_at", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inner = F.sum("size").over(W.partitionBy("source_at", "epoch", "range").orderBy("h", "id", "size", "copy").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = full.withColumn("upto", inner).join(offs.hint("merge"), ["source_at", "epoch", "range"])
    begin = F.col("epoch") * F.col("s_size") + F.col("off") + F.col("upto") - F.col("size")
    spans = spans.select("id", "copy", "size", "source_at", "epoch", "s_end", begin.alias("a"))
    spans = spans.where(F.col("a") < F.col("s_end"))
    pieces = spans.withColumn("block", F.explode(F.expr(f"sequence(a div {block}, (least(a + size, s_end) - 1) div {block})")))
    joined = placed.join(pieces.hint("merge"), ["source_at", "block"])  # both grow with the corpus: never broadcast
    upto = F.least(F.lit(block), F.lit(total) - F.col("slot") * block) + F.col("block") * block  # the last slot may be shorter
    start, stop = F.greatest("a", F.col("block") * block), F.least(F.col("a") + F.col("size"), "s_end", upto)
    schedule = joined.where(stop > start).select("slot", "source_at", "block", "id", "copy", "epoch", (start - F.col("a")).alias("start"), (stop - F.col("a")).alias("stop"))
    return Mix(facts.withColumnRenamed("n_rows", "rows"), docs_at.select("id", "copy", "size", "source", "source_at", "s_size", "s_target"), schedule)


FACTS = "source_at long, source string, s_size long, s_target double, slots long, n_rows long"


def _planned(spark, found: list, weights: tuple[float, ...], cap: int, block: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(facts, placed slots, words, block) of a few sources, planned by the driver."""
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in found]
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], cap) if found else []
    total = sum(sizes)
    block = fitting(targets, block)
    slots = -(-total // block)
    n_chunks, ends = -(-slots // CHUNK_SLOTS), thresholds(targets)

    def count_slots(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                counts = np.bincount(_points(c, slots, ends)[1], minlength=len(ends))
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(at), pa.array(counts[at])], ["chunk", "source_at", "n"])

    def place_slots(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                n, at = _points(c, slots, ends)
                order = np.argsort(at, kind="stable")
                own = at[order]
                rank = np.arange(len(own)) - np.searchsorted(own, own, "left")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c)), pa.array(own), pa.array(n[order]), pa.array(rank)], ["chunk", "source_at", "slot", "rank"])

    chunks = _chunks(spark, n_chunks)
    counts = chunks.mapInArrow(count_slots, "chunk long, source_at long, n long")
    got = {r["source_at"]: r["n"] for r in counts.groupBy("source_at").agg(F.sum("n").alias("n")).collect()}  # at most one row a source
    rows = [(i, r["source"], r["words"], targets[i], got.get(i, 0), r["rows"]) for i, r in enumerate(found)]
    facts = spark.createDataFrame(rows, FACTS).coalesce(1) if rows else spark.createDataFrame([], FACTS)
    return facts, _ranked(counts, chunks.mapInArrow(place_slots, "chunk long, source_at long, slot long, rank long")), total, block


def _chunks(spark, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism * 4)))


def _ranked(counts: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots with their rank within their source, from ranks within chunks and the chunks' counts."""
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("source_at").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("chunk", "source_at", F.coalesce("base", F.lit(0)).alias("base"))
    return slots.join(before.hint("merge"), ["chunk", "source_at"]).select("slot", "source_at", (F.col("base") + F.col("rank")).alias("block"))


def _running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` in order with its position in ``name``, and for each of ``sums`` the sum of a column over the rows before.

    Rows are sorted in ranges; each range runs by itself, and only one row a range is added up.
    """
    cols = df.columns

    def run(batches):
        from pyspark import TaskContext

        part, n, totals = TaskContext.get().partitionId(), 0, {c: 0 for c in sums.values()}
        for b in batches:
            made = []
            for c in sums.values():
                x = b.column(c).to_numpy(zero_copy_only=False)
                upto = totals[c] + np.cumsum(x)
                made.append(pa.array(np.concatenate([[totals[c]], upto[:-1]]).astype(x.dtype) if len(x) else x))
                totals[c] = upto[-1] if len(x) else totals[c]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(np.arange(n, n + b.num_rows)), *made], [*cols, "part__", "at__", *[f"{s}__" for s in sums]])
            n += b.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    extra = "".join(f", `{s}__` {df.schema[c].dataType.simpleString()}" for s, c in sums.items())
    done, _ = written(df.orderBy(*order).mapInArrow(run, f"{fields}, part__ long, at__ long{extra}"), "running")
    ends = done.groupBy("part__").agg(F.count("*").alias("n__"), *[F.sum(c).alias(f"t_{s}") for s, c in sums.items()])
    upto = W.orderBy("part__").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = ends.select("part__", F.coalesce(F.sum("n__").over(upto), F.lit(0)).alias("n0__"), *[F.coalesce(F.sum(f"t_{s}").over(upto), F.lit(0)).alias(f"b_{s}") for s in sums])
    out = done.join(base, "part__")
    return out.select(*cols, (F.col("n0__") + F.col("at__")).alias(name), *[(F.col(f"b_{s}") + F.col(f"{s}__")).alias(s) for s in sums])


def _planned_apart(found: DataFrame, weights: tuple[float, ...], cap: int, block: int) -> tuple[DataFrame, DataFrame, int, int]:
    """``_planned`` for any number of sources: sorted ranges and joins in place of lists."""
    spark = found.sparkSession
    at = _running(found, [F.col("source").isNull(), F.col("source")], {}, "source_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_at") % len(weights) + 1).cast("int"))
    at = at.withColumn("w", weight).withColumn("most", cap * F.col("words"))
    total, all_w = at.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    filled = _running(at, [F.col("most") / F.col("w"), F.col("source_at")], {"before": "most", "w_before": "w"}, "k")
    level = (F.lit(total) - F.col("before")) / (F.lit(all_w) - F.col("w_before"))
    filled = filled.withColumn("level", level)
    stop = filled.where(F.col("most") >= F.col("level") * F.col("w")).agg(F.min(F.struct("k", "level")).alias("s")).first()["s"]
    k0, level0 = (stop["k"], stop["level"]) if stop else (at.count(), 0.0)
    aimed = filled.withColumn("s_target", F.when(F.col("k") < k0, F.col("most").cast("double")).otherwise(F.lit(level0) * F.col("w")))
    least, all_t, last = aimed.where("s_target > 0").agg(F.min("s_target"), F.sum("s_target"), F.max("source_at")).first()
    block = min(block, max(1, math.ceil((all_t or 0) / MOST_SLOTS), int((least or block * BLOCKS) / BLOCKS)))
    slots = -(-total // block)
    ranged = _running(aimed.select("source", "source_at", "words", "rows", "s_target"), [F.col("source_at")], {"t0": "s_target"}, "again")
    low = lambda x: F.least(F.floor(x / F.lit(float(all_t or 1)) * 4294967296.0), F.lit(1 << 32))
    ranged = ranged.withColumn("lo", low(F.col("t0"))).withColumn("hi", F.when(F.col("source_at") == last, F.lit(1 << 32)).otherwise(low(F.col("t0") + F.col("s_target"))))
    parts = ranged.where("hi > lo").select("source_at", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {RANGE_BITS}), shiftright(hi - 1, {RANGE_BITS}))")).alias("range"))

    def points(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                n = np.arange(c * CHUNK_SLOTS, min((c + 1) * CHUNK_SLOTS, slots), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    point = ((n * np.uint64(GOLDEN)) >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(n.astype(np.int64)), pa.array(point), pa.array(point >> RANGE_BITS)], ["chunk", "slot", "point", "range"])

    every = _chunks(spark, -(-slots // CHUNK_SLOTS)).mapInArrow(points, "chunk long, slot long, point long, range long")
    met, _ = written(every.join(parts, "range").where("point >= lo and point < hi").select("chunk", "source_at", "slot"), "slots")
    ranks = met.withColumn("rank", F.row_number().over(W.partitionBy("chunk", "source_at").orderBy("slot")).cast("long") - 1)
    counts = met.groupBy("chunk", "source_at").agg(F.count("*").alias("n"))
    got = met.groupBy("source_at").agg(F.count("*").alias("slots"))
    facts = ranged.join(got, "source_at", "left").select("source_at", "source", F.col("words").alias("s_size"), "s_target", F.coalesce("slots", F.lit(0)).alias("slots"), F.col("rows").alias("n_rows"))
    return written(facts, "mix-facts")[0], _ranked(counts, ranks), total, block


def taken_rows(m: Mix) -> DataFrame:
    """``taken`` with ``source`` and ``copy``, which tells apart rows of one id, source and size."""
    words = m.schedule.groupBy("id", "copy", "source_at").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    left, right = m.docs.alias("l"), words.alias("r")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.copy") == F.col("r.copy")) & (F.col("l.source_at") == F.col("r.source_at"))
    sized = left.join(right, same & (F.col("l.size") > 0), "left")
    return sized.select(F.col("l.id").alias("doc_id"), F.col("l.source").alias("source"), F.col("l.copy").alias("copy"), F.col("l.size").alias("size"), F.col("l.s_size").alias("source_size"), F.col("l.s_target").alias("target"), F.coalesce("r.taken", F.lit(0)).cast("long").alias("taken"))


def taken(m: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document: the words that the mix takes, repeats counted."""
    return taken_rows(m).drop("source", "copy")


def mixed(docs: DataFrame, m: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and taken: the mixed corpus, each document with the words to take of it."""
    made = ["size", "source_size", "target", "taken"]
    own = docs.drop(*made)
    place = W.partitionBy(f"`{id_col}`", f"`{source_col}`", "size").orderBy(F.xxhash64(f"`{text_col}`"))
    rows = own.withColumn("size", word_count(F.col(f"`{text_col}`"))).withColumn("copy__", F.row_number().over(place))
    got = taken_rows(m).toDF("id__", "source__", "copy2__", "size__", *made[1:])
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("id__")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("source__")) & (F.col("size") == F.col("size__")) & (F.col("copy__") == F.col("copy2__"))
    return rows.join(got, same).select(*own.columns, *made)
