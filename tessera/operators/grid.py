"""Exact top-k of the blocking join, block by block, and records met with their pairs, without a shuffle of hits.

The relational join makes a row for each token that a query and a pool record share: pool times queries, under a cap that grows
with the pool. Here a task holds the inverted index of one block of a country's pool in memory, and a slice of its queries
streams past: the whole product is scored and only each query's best leave the task. Blocks are bounded by postings, so
memory does not grow with the pool; a query's best of several blocks are ranked once more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from tessera.operators.blocking import MOST_HEAVY, Blocking, _cap, frequencies, idf, postings
from tessera.sources.tables import freed, removed, table

#: Postings of one pool block; four bytes each stay in memory, some thirty while the block is sorted.
BLOCK = 6_000_000
#: Cells a country is dealt into at least, if it has so many slices of this many queries.
CELLS, SLICE = 4, 10_000
#: The same where records carry what pairs are judged by: a pool is copied once for each slice.
JUDGED = 2
#: Blocks' worth of postings that ``worded`` leaves to one task, which keeps no frequencies with them.
WHOLE = 1.5
#: Records of each side that one cell of ``meet`` holds, about.
MET = 500_000


@dataclass(frozen=True)
class Variant:
    """Which cap of the index is used, and how dot products are scaled."""

    cap: int = 0
    norm: str = "candidate"


@dataclass(frozen=True)
class Packed:
    """(country, id, is_query, n, t, d, m): a record a row with its kept tokens, their frequencies and marks (cap bits, name).

    Also ``x``, if records carry what their pairs are judged by. With ``channels``, rows have ``w``, their kept words by channel,
    in place of t, d and m: a task makes t and m of them, and d is what it counts.
    """

    rows: DataFrame
    cells: list[tuple[str, int, int]]
    channels: tuple[str, ...] = ()

    @property
    def single(self) -> bool:
        """Whether each country's pool is one block, so that a query's best are final in the task that finds them."""
        return all(b == 1 for _, b, _ in self.cells)


def pack(records: DataFrame, channels: dict[str, str], p: Blocking, fracs: tuple[float, ...] = ()) -> Packed:
    """The index of ``records``."""
    fracs = fracs or (p.df_frac,)
    assert len(fracs) <= 6, "a mark has six bits"
    posts, at = table(postings(records, channels), "postings", where=True)
    counts, counts_at = table(frequencies(posts), "counts", where=True)
    weights, weights_at = table(idf(posts, p, fracs, counts).withColumn("t", F.monotonically_increasing_id()), "weights", where=True)
    keys = ["country", "channel", "tok"]
    over = counts.join(weights, keys, "left_anti").select(*keys)
    over, over_at = table(over, "heavy", where=True)
    light = posts.where("channel <> ''")
    if 0 < over.count() <= MOST_HEAVY:  # else the join below drops them
        light = light.join(F.broadcast(over), keys, "left_anti")
    size = posts.where("channel = '' and not is_query").groupBy("country").agg(F.count("*").alias("n"))
    asked = posts.where("channel = '' and is_query").groupBy("country").agg(F.count("*").alias("queries"))
    held = weights.groupBy("country").agg(F.sum("df").alias("nnz")).join(asked, "country").join(size, "country").collect()  # a row a country
    cells = []
    for row in held:
        blocks = -(-row["nnz"] // BLOCK)
        cells.append((row["country"], int(blocks), int(min(-(-row["queries"] // SLICE), -(-CELLS // blocks)))))
    bits = sum((F.when(F.col("kept")[k], 1 << k).otherwise(0) for k in range(len(fracs))), F.lit(0))
    mark = (bits + F.when(F.col("channel") == "name", 64).otherwise(0)).cast("byte")
    one = F.struct("t", F.col("df").cast("int").alias("d"), mark.alias("m"))
    df = light.join(weights.select(*keys, "t", "df", "kept"), keys).select("country", "id", "is_query", one.alias("one"))
    df = df.groupBy("country", "id", "is_query").agg(F.collect_list("one").alias("l"))
    # rows of one id are one record; Spark compares structs each with each, so they are only where numbers repeat
    df = df.withColumn("l", F.when(F.size(F.array_distinct("l.t")) == F.size("l"), F.col("l")).otherwise(F.array_distinct("l")))
    df = df.join(F.broadcast(size), "country").select("country", "id", "is_query", "n", F.col("l.t").alias("t"), F.col("l.d").alias("d"), F.col("l.m").alias("m"))
    made = table(df, "packed")
    for path in (at, counts_at, weights_at, over_at):
        removed(records.sparkSession, path)
    return Packed(made, cells)


def worded(records: DataFrame, channels: dict[str, str], p: Blocking) -> Packed | None:
    """The same index, with each record's kept words in place of their numbers, for pools that one task holds whole; else None.

    Only the few words over the cap are looked up in a table, so no row a posting is made but to count them. ``records`` also
    have ``x``, a struct; their ids are unique. None as well if two words have the same hash, or very many are over the cap.
    """
    spark, of = records.sparkSession, ["country", "channel"]
    posts = postings(records, channels).where("channel <> ''")
    counts, at = table(posts.groupBy(*of, "tok").agg(F.sum((~F.col("is_query")).cast("int")).alias("df")), "counts", where=True)
    twins = counts.groupBy("country", F.xxhash64("channel", "tok").alias("t")).count().where("count > 1").limit(1).count()
    side = lambda asked: records.where(F.col("is_query") == asked).groupBy("country").agg(F.count("*").alias("n"))
    size = side(False)
    known = counts.where("df > 0").join(F.broadcast(size), "country").withColumn("over", F.col("df") > _cap(p, p.df_frac, F.col("n")))
    vocab = known.groupBy(*of).agg(F.count("*").alias("vocab"), F.min("over").alias("all"), F.sum("df").alias("nnz"))  # a row a channel
    over, over_at = table(known.where("over").select(*of, "tok", "df"), "heavy", where=True)
    many = over.count()
    made = None
    if not twins and many <= MOST_HEAVY:
        rare = F.row_number().over(W.partitionBy(*of).orderBy("df", "tok"))  # where all are over the cap, their rarest tenth stays
        over = over.withColumn("r", rare).join(F.broadcast(vocab.select(*of, "vocab", "all")), of).where(~F.col("all") | (F.col("r") > F.greatest(F.lit(1), F.expr("vocab div 10"))))
        each = {c: F.collect_list(F.when(F.col("channel") == c, F.col("tok"))).alias(f"over_{k}") for k, c in enumerate(channels)}
        over = over.groupBy("country").agg(*each.values(), F.sum("df").alias("lost"))
        over, lists_at = table(size.join(over, "country", "left"), "over", where=True)
        held = vocab.groupBy("country").agg(F.sum("nnz").alias("nnz")).join(side(True).withColumnRenamed("n", "queries"), "country").join(over.select("country", "lost"), "country")
        held = held.select("country", (F.col("nnz") - F.coalesce("lost", F.lit(0))).alias("nnz"), "queries").collect()  # a row a country
        if all(row["nnz"] <= WHOLE * BLOCK for row in held):
            cells = [(row["country"], 1, int(min(-(-row["queries"] // SLICE), JUDGED))) for row in held]
            words = lambda k, v: F.array_except(F.filter(F.split(F.col(v), " "), lambda t: F.length(t) >= 2), F.coalesce(f"over_{k}", F.array().cast("array<string>")))
            w = F.struct(*[F.array_join(words(k, v), " ").alias(c) for k, (c, v) in enumerate(channels.items())])
            df = records.join(F.broadcast(over), "country").select("country", "id", "is_query", "n", w.alias("w"), "x")
            made = Packed(df.where(" or ".join(f"w.{c} <> ''" for c in channels)), cells, tuple(channels))
        else:
            removed(spark, lists_at)
    removed(spark, at)
    removed(spark, over_at)
    return made


def _numbered(dealt: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Rows with t and m of their words."""
    words = {c: F.filter(F.split(f"w.{c}", " "), lambda t: t != "") for c in channels}
    number = lambda c: lambda x: F.xxhash64(F.lit(c), x)  # noqa: E731  transform() counts a lambda's parameters
    t = F.concat(*[F.transform(v, number(c)) for c, v in words.items()])
    m = F.concat(*[F.array_repeat(F.lit(65 if c == "name" else 1).cast("byte"), F.size(v)) for c, v in words.items()])
    return dealt.withColumns({"t": t, "m": m}).drop("w")


# --- inside a task ---------------------------------------------------------------------------------------------------------


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _norms(t_sq: np.ndarray, of: np.ndarray, n: int, mask: np.ndarray) -> np.ndarray:
    """Reciprocal norms of n records; 0 where a record has none."""
    s = np.sqrt(np.bincount(of[mask], weights=t_sq[mask], minlength=n))
    return np.divide(1.0, s, out=np.zeros(n), where=s > 0)


def _best(idx: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k positive scores of ``s``, in six digits, ties by ``idx``."""
    at = np.flatnonzero(s > 0)
    if not k or not len(at):
        return at[:0]
    r = np.floor(s[at] * 1e6 + 0.5)
    if len(at) > k:
        keep = r >= np.partition(r, len(r) - k)[len(r) - k]
        at, r = at[keep], r[keep]
    return at[np.lexsort((idx[at], -r))[:k]]


def _pick(idx: np.ndarray, n: np.ndarray, a: np.ndarray, p: Blocking) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, rank, in_name) of the blended best united with the best by name."""
    main, name = _best(idx, p.weight * n + (1 - p.weight) * a, p.k_main), _best(idx, n, p.k_name)
    more = name[~np.isin(name, main)]
    at = np.concatenate((main, more))
    return at, np.concatenate((np.arange(len(main)), np.full(len(more), p.k_main))).astype(np.int32), np.isin(at, name).astype(np.int32)


#: (queries' x, each pair's position there, pool records' ids and x, ranks) to (positions of pairs kept, columns of these).
Judge = Callable[[pa.StructArray, np.ndarray, pa.Array, pa.StructArray, np.ndarray], tuple[np.ndarray, dict[str, pa.Array]]]


class _Block:
    """The inverted index of a pool block; a token's records are a slice of ``rows``."""

    def __init__(self, batches: list, variants: list[Variant]):
        ids, carried, t, d, m, length, n = [], [], [], [], [], [], 1
        for b in batches:
            ids.append(b.column("id"))
            if "x" in b.schema.names:
                carried.append(b.column("x"))
            for name, into in (("t", t), ("d", d), ("m", m)):
                if name in b.schema.names:
                    values, sizes = _lists(b.column(name))
                    into.append(values)
            length.append(sizes)
            n = b.column("n")[0].as_py()
        batches.clear()
        self.ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        self.x = pa.concat_arrays(carried) if carried else None
        size = len(self.ids)
        t, d, m = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (t, d, m))
        of = np.repeat(np.arange(size, dtype=np.int32), np.concatenate(length) if length else [])
        order = np.argsort(t, kind="stable")
        t, self.rows, m = t[order], of[order], m[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        self.keys, self.start, self.end = t[first], first, np.append(first[1:], len(t))
        del t, of
        self.counts = d[order[first]] if len(d) else self.end - self.start  # all of a word's records are here, if d is not given
        del order, d
        sq = np.repeat(np.log(n / self.counts) ** 2, self.end - self.start) if len(self.rows) else np.zeros(0)
        self.norms = {}
        for v in {x.cap for x in variants}:
            on = (m >> v) & 1 == 1
            self.norms[v] = (_norms(sq, self.rows, size, on & (m >= 64)), _norms(sq, self.rows, size, on & (m < 64)))
        del sq
        self.acc = np.zeros(size), np.zeros(size)

    def find(self, t: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, t)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == t, at, -1) if len(self.keys) else np.full(len(t), -1)

    def meets(self, at: np.ndarray, sq: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows in order, sums by name, sums by the others) of a query's tokens."""
        starts, ends = self.start[at], self.end[at]
        if (ends - starts).sum() * 8 > len(self.ids):
            sums = []
            for side in (name, ~name):
                parts = [self.rows[s:e] for s, e in zip(starts[side], ends[side])]
                if parts:
                    sums.append(np.bincount(np.concatenate(parts), weights=np.repeat(sq[side], ends[side] - starts[side]), minlength=len(self.ids)))
                else:
                    sums.append(np.zeros(len(self.ids)))
            idx = np.flatnonzero(sums[0] + sums[1])  # what is scaled and ranked from here on is what was met
            return idx, sums[0][idx], sums[1][idx]
        parts = []
        for s, e, x, side in zip(starts, ends, sq, name):
            parts.append(rows := self.rows[s:e])
            self.acc[0 if side else 1][rows] += x  # a token meets a record once
        idx = np.concatenate(parts)
        idx.sort()
        idx = idx[np.concatenate(([True], idx[1:] != idx[:-1]))]
        out = idx, self.acc[0][idx], self.acc[1][idx]
        self.acc[0][idx] = self.acc[1][idx] = 0.0
        return out


def _searched(batch, block: _Block, p: Blocking, variants: list[Variant], last: bool, judge: Judge | None = None):
    """The best of each query of a batch in a block; ``last``: with their final ranks; ``judge``: a row for each pair it keeps."""
    (t, size), (m, _) = (_lists(batch.column(x)) for x in ("t", "m"))
    ends = np.cumsum(size)
    at = block.find(t)
    d = _lists(batch.column("d"))[0] if "d" in batch.schema.names else np.where(at >= 0, block.counts[at], 1) if len(block.keys) else np.ones(len(t))
    sq = np.log(batch.column("n")[0].as_py() / d) ** 2
    who, which, take, lens, ns, as_, ranks, ins = [], [], [], [], [], [], [], []
    for i in range(batch.num_rows):
        span = slice(ends[i] - size[i], ends[i])
        for k, v in enumerate(variants):
            on = (at[span] >= 0) & ((m[span] >> v.cap) & 1 == 1)
            if not on.any():
                continue
            mine, mm = sq[span], m[span]
            idx, n, a = block.meets(at[span][on], mine[on], mm[on] >= 64)
            if v.norm != "none":
                n, a = n * block.norms[v.cap][0][idx], a * block.norms[v.cap][1][idx]
            if v.norm == "full":
                kept = (mm >> v.cap) & 1 == 1
                n, a = (x / (np.sqrt(mine[kept & side].sum()) or 1.0) for x, side in ((n, mm >= 64), (a, mm < 64)))
            got, rank, in_name = _pick(idx, n, a, p)
            if len(got):
                who.append(i), which.append(k), take.append(idx[got]), lens.append(len(got)), ns.append(n[got]), as_.append(a[got]), ranks.append(rank), ins.append(in_name)
    if not who:
        return
    if judge:
        if block.x is None:
            return
        rows, take = np.repeat(who, lens), np.concatenate(take)
        on, made = judge(batch.column("x"), rows, block.ids.take(pa.array(take)), block.x.take(pa.array(take)), np.concatenate(ranks))
        rows = pa.array(rows[on])
        yield pa.RecordBatch.from_arrays([batch.column("country").take(rows), batch.column("id").take(rows), block.ids.take(pa.array(take[on])), *made.values()], names=["country", "q", "c", *made])
        return
    offsets = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32())
    of = lambda x: pa.ListArray.from_arrays(offsets, x)
    flat = [block.ids.take(pa.array(np.concatenate(take))), pa.array(np.concatenate(ns)), pa.array(np.concatenate(as_)), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(ins))]
    rows = pa.array(who, pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), batch.column("country").take(rows), batch.column("id").take(rows), *map(of, flat if last else flat[:3])], names=["v", "country", "q", "c", "ncos", "acos", *(["rank", "in_name"] if last else [])])


def _runs(batch, *names: str):
    """Parts of a batch with equal values in the named columns."""
    cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    for s, e in zip([0, *change], [*change, batch.num_rows]):
        yield tuple(c[s] for c in cols), batch.slice(s, e - s)


def _dealt(packed: Packed, search: Callable, variants: list[Variant], schema: str) -> DataFrame:
    """What ``search(batch of queries, block)`` makes of the cells of an index."""
    freed(packed.rows.sparkSession)  # what the index was shuffled by
    rows = packed.rows
    grid = rows.sparkSession.createDataFrame(packed.cells or [("", 1, 1)], "country string, blocks int, slices int")
    rows = rows.join(F.broadcast(grid), rows["country"].eqNullSafe(grid["country"])).drop(grid["country"])
    block = F.when(F.col("is_query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    part = F.when(F.col("is_query"), F.array(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = rows.select("*", F.explode(block).alias("b")).select("*", F.explode(part).alias("s"))
    n = max(1, sum(b * s for _, b, s in packed.cells))
    cell = F.struct("country", "b", "s")
    dealt = dealt.select(F.xxhash64(cell).alias("cell"), *packed.rows.columns)
    dealt = dealt.repartition(3 * n, "cell").sortWithinPartitions("cell", "is_query", "id")
    dealt = _numbered(dealt, packed.channels) if packed.channels else dealt

    def cells(batches):
        now, pool, built = None, [], None
        for whole in batches:
            for (at, asks), part in _runs(whole, "cell", "is_query"):
                if at != now:
                    now, pool, built = at, [], None
                if not asks:
                    pool.append(part)
                    continue
                built = built or _Block(pool, variants)
                for s in range(0, part.num_rows, 1000):
                    yield from search(part.slice(s, 1000), built)

    return dealt.mapInArrow(cells, schema)


def judged(packed: Packed, p: Blocking, judge: Judge, schema: str) -> DataFrame:
    """(country, q, c, and the columns of ``schema``) of the candidates that ``judge`` keeps, for an index of ``worded``.

    A pair is judged by what its records carry, in the task that finds it; pairs that are not kept never leave it.
    """
    assert packed.single, "candidates of several blocks have no final rank in a task"
    kind, one = packed.rows.schema["id"].dataType.simpleString(), [Variant()]
    return _dealt(packed, lambda part, block: _searched(part, block, p, one, True, judge), one, f"country string, q {kind}, c {kind}, {schema}")


def best(packed: Packed, p: Blocking, variants: tuple[Variant, ...] = (Variant(),)) -> DataFrame:
    """(v, country, q, c, ncos, acos, rank, in_name): a row for each query and variant that meets anything, candidates as lists."""
    variants, single = list(variants), packed.single
    kind = packed.rows.schema["id"].dataType.simpleString()
    schema = f"v int, country string, q {kind}, c array<{kind}>, ncos array<double>, acos array<double>"
    final = f"{schema}, rank array<int>, in_name array<int>"
    met = _dealt(packed, lambda part, block: _searched(part, block, p, variants, single), variants, final if single else schema)
    if single:
        return met
    flat = [F.flatten(F.collect_list(x)).alias(x) for x in ("c", "ncos", "acos")]
    met = met.groupBy("v", "country", "q").agg(*flat)

    def settle(batches):
        for b in batches:
            (n, size), (a, _), (c, _) = (_lists(b.column(x)) for x in ("ncos", "acos", "c"))
            ids, ends, take, lens, ranks, ins = b.column("c").flatten(), np.cumsum(size), [], [], [], []
            for i in range(b.num_rows):
                s = slice(ends[i] - size[i], ends[i])
                got, rank, in_name = _pick(np.argsort(np.argsort(c[s])), n[s], a[s], p)
                take.append(got + s.start), lens.append(len(got)), ranks.append(rank), ins.append(in_name)
            offsets, at = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), np.concatenate(take)
            flat = [ids.take(pa.array(at)), pa.array(n[at]), pa.array(a[at]), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(ins))]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("v", "country", "q")], *[pa.ListArray.from_arrays(offsets, x) for x in flat]], names=["v", "country", "q", "c", "ncos", "acos", "rank", "in_name"])

    return met.mapInArrow(settle, final)


def found(lists: DataFrame, p: Blocking, *more: Column) -> DataFrame:
    """(country, q, c, blk, ncos, acos, rank, in_name) of the lists of ``best``, and columns of each list."""
    zipped = F.arrays_zip("c", "ncos", "acos", "rank", "in_name")
    df = lists.select("country", "q", *more, F.inline(zipped))
    names = [x for x in df.columns if x not in ("country", "q", "c", "ncos", "acos", "rank", "in_name")]
    return df.select("country", "q", "c", (F.lit(p.weight) * F.col("ncos") + F.lit(1 - p.weight) * F.col("acos")).alias("blk"), "ncos", "acos", "rank", "in_name", *names)


def within(lists: DataFrame, p: Blocking) -> DataFrame:
    """The candidates of ``lists`` with n_cand, blk_rel and blk_gap, as of ``features.within_query``."""
    blk = F.zip_with("ncos", "acos", lambda n, a: F.lit(p.weight) * n + F.lit(1 - p.weight) * a)
    df = found(lists, p, F.size("c").alias("n_cand"), F.array_max(blk).alias("best"))
    return df.withColumns({"n_cand": F.col("n_cand").cast("long"), "blk_rel": F.col("blk") / F.greatest("best", F.lit(1e-6)), "blk_gap": F.col("best") - F.col("blk")}).drop("best")


def candidates(records: DataFrame, channels: dict[str, str], p: Blocking) -> DataFrame:
    """Blended top k united with name-only top k, of records (country, id, is_query, and the channels' columns)."""
    return found(best(pack(records, channels, p), p), p)


@dataclass(frozen=True)
class Score:
    """What ``meet`` makes of pairs: ``made(a, i, b, j)`` of what ``read`` made of each side's records, and their positions there."""

    read: Callable[[pa.StructArray], object]
    made: Callable[[object, np.ndarray, object, np.ndarray], np.ndarray]
    name: str
    kind: str = "double"


def meet(pairs: DataFrame, left: DataFrame, right: DataFrame, score: Score | None = None) -> DataFrame:
    """``pairs`` (q, c, ...) with a struct ``a`` of the columns of ``left`` (id, ...) and ``b`` of those of ``right``; inner.

    Pairs are dealt to a grid of record blocks and records go to their row or column of it, so a text is moved a few times
    and not once for each of its pairs. With ``score``, its column stands in place of ``a`` and ``b``: records are read
    once in each cell, and do not leave it.
    """
    size = [max(least, -(-df.count() // most)) for df, least, most in ((left, 3, MET), (right, 4, MET))]
    at = [F.pmod(F.xxhash64(x), F.lit(n)).cast("int") for x, n in zip(("q", "c"), size)]
    bare = [x for x in pairs.columns if x not in ("q", "c")]
    cell = lambda i, j: F.xxhash64(i, j)
    both = pairs.select(F.lit(2).alias("kind"), cell(*at).alias("cell"), "q", "c", *([F.struct(*bare).alias("x")] if bare else []))
    side = lambda df, name: df.select(F.col("id").alias(name), F.struct(*df.columns).alias("a" if name == "q" else "b"))
    a = side(left, "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(size[1] - 1))).alias("j")).select(F.lit(0).alias("kind"), cell(at[0], F.col("j")).alias("cell"), "q", "a")
    b = side(right, "c").select("*", F.explode(F.sequence(F.lit(0), F.lit(size[0] - 1))).alias("i")).select(F.lit(1).alias("kind"), cell(F.col("i"), at[1]).alias("cell"), "c", "b")
    tagged = both.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    tagged = tagged.repartition(3 * size[0] * size[1], "cell").sortWithinPartitions("cell", "kind")
    out = tagged.drop("kind", "cell")
    names = out.columns

    def joined(batches):
        now, held, found = None, ([], []), None
        for whole in batches:
            for (cell, kind), part in _runs(whole, "cell", "kind"):
                if cell != now:
                    now, held, found = cell, ([], []), None
                if kind < 2:
                    held[kind].append(part)
                    continue
                if found is None:
                    found = []
                    for parts, key, name in zip(held, ("q", "c"), ("a", "b")):
                        ids = pa.concat_arrays([p.column(key) for p in parts]) if parts else part.column(key)[:0]
                        rows = pa.concat_arrays([p.column(name) for p in parts]) if parts else part.column(name)[:0]
                        found.append((pd.Index(ids.to_pandas()), rows, key, name))
                        if score:
                            found[-1] = (found[-1][0], score.read(rows), key, name)
                    held[0].clear(), held[1].clear()
                if all(index.is_unique for index, *_ in found):
                    spots = [index.get_indexer(part.column(key).to_pandas()) for index, _, key, _ in found]
                    on = np.flatnonzero((spots[0] >= 0) & (spots[1] >= 0))
                    spots = [s[on] for s in spots]
                else:  # an id of several records meets a pair with each
                    frame = pd.DataFrame({"q": part.column("q").to_pandas(), "c": part.column("c").to_pandas(), "i": np.arange(part.num_rows)})
                    for index, _, key, name in found:
                        frame = frame.merge(pd.DataFrame({key: index, name: np.arange(len(index))}), on=key)
                    on, spots = frame["i"].to_numpy(), [frame["a"].to_numpy(), frame["b"].to_numpy()]
                kept = part.take(pa.array(on, pa.int64()))
                if score:
                    scores = pa.array(score.made(found[0][1], spots[0], found[1][1], spots[1]))
                    yield pa.RecordBatch.from_arrays([*[kept.column(n) for n in names if n not in ("a", "b")], scores], names=[*[n for n in names if n not in ("a", "b")], score.name])
                    continue
                got = {name: rows.take(pa.array(s, pa.int64())) for (_, rows, _, name), s in zip(found, spots)}
                yield pa.RecordBatch.from_arrays([got[n] if n in got else kept.column(n) for n in names], names=names)

    if score:
        schema = StructType([f for f in out.schema if f.name not in ("a", "b")]).add(score.name, score.kind)
    made = tagged.mapInArrow(joined, schema if score else out.schema)
    return made.select("q", "c", *[F.col(f"x.{k}").alias(k) for k in bare], *([score.name] if score else ["a", "b"]))


def sweep(records: DataFrame, channels: dict[str, str], truth: DataFrame, p: Blocking, fracs: list[float], slack: float = 0.005) -> DataFrame:
    """(df_frac, pairs, per_query, recall, chosen) of candidate sets at several caps, from one index.

    ``chosen`` marks the smallest cap whose recall is within ``slack`` of the best.
    """
    from pyspark.sql.window import Window as W

    lists = best(pack(records, channels, p, tuple(fracs)), p, tuple(Variant(k) for k in range(len(fracs))))
    per = _hit(lists, truth).groupBy("v").agg(F.sum(F.size("c")).alias("pairs"), F.count("*").alias("n_q"), F.sum(F.size("hit")).alias("hit"))
    steps = F.array(*[F.lit(float(f)) for f in fracs])
    per = per.withColumn("df_frac", F.get(steps, F.col("v")))
    all_ = F.broadcast(truth.select("q", "c").distinct().agg(F.count("*").alias("n")))  # one row
    out = per.join(all_).select("df_frac", "pairs", F.round(F.col("pairs") / F.greatest("n_q", F.lit(1)), 6).alias("per_query"), F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6).alias("recall"))
    good = F.col("recall") >= F.max("recall").over(W.partitionBy()) - slack  # a row a cap
    out = out.withColumn("good", good)
    return out.withColumn("chosen", (F.col("df_frac") == F.min(F.when(F.col("good"), F.col("df_frac"))).over(W.partitionBy())).cast("int")).drop("good")


def _hit(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """``lists`` with ``hit``: the list positions, from 0, that ``truth`` (q, c) has. Lists are joined whole, by q."""
    true = truth.groupBy("q").agg(F.collect_set("c").alias("true"))
    df = lists.select("v", "q", "c", "rank").join(true, "q", "left")
    marks = F.transform("c", lambda c, i: F.when(F.array_contains("true", c), i))
    return df.withColumn("hit", F.filter(F.coalesce(marks, F.array().cast("array<int>")), lambda i: i.isNotNull()))


def recall(records: DataFrame, channels: dict[str, str], truth: DataFrame, p: Blocking) -> DataFrame:
    """(found, recall): how many of the ``truth`` pairs are candidates."""
    hit = _hit(best(pack(records, channels, p), p), truth).agg(F.coalesce(F.sum(F.size("hit")), F.lit(0)).alias("found"))
    return hit.crossJoin(truth.agg(F.count("*").alias("n"))).select("found", F.round(F.col("found") / F.col("n"), 6).alias("recall"))  # one row each


def variants(records: DataFrame, channels: dict[str, str], truth: DataFrame, p: Blocking, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(variant, recall_k, ...): recall at k of truth pairs by blended rank, with weights scaled in different ways, from one index."""
    names = ("candidate", "full", "none")
    q = replace(p, k_main=max(ks), k_name=0)
    hits = _hit(best(pack(records, channels, q), q, tuple(Variant(0, n) for n in names)), truth)
    under = lambda k: F.filter("hit", lambda i: F.get("rank", i) < k)
    per = hits.groupBy("v").agg(*[F.sum(F.size(under(k))).alias(f"k{k}") for k in ks])
    total = truth.select("q", "c").distinct().agg(F.count("*").alias("n")).select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.lit(n).alias("variant")) for i, n in enumerate(names)])).alias("x")).select("n", "x.*")
    return total.join(per, "v", "left").select("variant", *[F.round(F.coalesce(f"k{k}", F.lit(0)) / F.greatest("n", F.lit(1)), 6).alias(f"recall_{k}") for k in ks])
