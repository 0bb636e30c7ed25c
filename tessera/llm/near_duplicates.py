"""MinHash near-duplicates with tensored banding.

Each text's distinct word shingles get ``collections`` MinHash keys of ``rows`` minima each. A table key combines the
keys of two collections, so m collections make m(m-1)/2 tables: 16 collections of 3 minima stand for 120 tables of 6,
at 48 minima instead of 720. A pair of Jaccard similarity s meets in a table if it agrees in two collections or more: at
s = 0.8 with the defaults it is missed with probability 0.0002, at 0.85 with less than 0.00001.

Candidates are settled without ever listing a bucket's pairs:

1. texts with equal sets become one node;
2. each bucket ties its nodes to its least node; ties whose bit sketches prove them below the limit go;
3. ties are confirmed on the full sets, a spanning forest first, then whatever ties still run between components;
4. buckets that still hold several components of confirmed links are searched in blocks: pairs of different components
   whose sketches allow the limit are ties too, and are confirmed likewise;
5. components of the confirmed links are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.text import among, mix, parts, removed, word_shingles, written

#: Bits of a sketch; the sketch of a set has a bit for each element's hash.
SKETCH_BITS = 2048
#: Rows of a bucket that one block holds.
BLOCK = 1000


@dataclass(frozen=True)
class Banding:
    """Collections and minima a collection; more minima for larger corpora, where chance collisions grow."""

    collections: int = 16
    rows: int = 3

    @property
    def tables(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.collections) for j in range(i + 1, self.collections)]


def signature(raw: np.ndarray, offsets: np.ndarray, shingle: int, banding: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size, two digest halves, collection keys and sketch of each row."""
    n_rows = len(offsets) - 1
    row, value = word_shingles(raw, offsets, shingle)
    size = np.bincount(row, minlength=n_rows)
    d1, d2 = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    keys = np.zeros((n_rows, banding.collections), np.uint64)
    sketch = np.zeros((n_rows, SKETCH_BITS), bool)
    if len(row):
        full = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[full]
        rng = np.random.default_rng(7)
        with np.errstate(over="ignore"):
            d1[full] = np.add.reduceat(mix(value + np.uint64(1)), first)
            d2[full] = np.add.reduceat(mix(value ^ np.uint64(0x5555555555555555)), first)
            for c in range(banding.collections):
                key = np.full(len(full), np.uint64(c + 1))
                for _ in range(banding.rows):
                    flip, factor = rng.integers(0, 2**64, dtype=np.uint64), rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((value ^ flip) * factor, first))
                keys[full, c] = key
        sketch[row, (value >> np.uint64(64 - 11)).astype(np.int64) if SKETCH_BITS == 2048 else (value % np.uint64(SKETCH_BITS)).astype(np.int64)] = True
    return size, d1, d2, keys, np.packbits(sketch, axis=1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, (len(data) + 1) * width, width, dtype=np.int32) if len(data) else np.zeros(1, np.int32)), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _enough(size_a: np.ndarray, size_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` elements at least can reach the similarity."""
    total = size_a + size_b
    return 100 * (total - apart) >= percent * (total + apart)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", banding: Banding = Banding(), block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the least id
    reachable over links and ``kept`` marks the row whose id that is. A text of fewer words than a shingle is one shingle;
    null texts and texts without words have no shingles and no links. Rows that share an id count as one document. A row
    without an id takes no part: its ``component_id`` is null and it is kept. Other columns are ignored, whatever their
    names; an empty table gives an empty result. A text of any length is taken whole, its distinct shingles by one task.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches):
        for b in batches:
            for a, z, raw, offsets in parts(b.column(1)):
                size, d1, d2, keys, sketch = signature(raw, offsets, shingle, banding)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), _long(size), _long(d1), _long(d2), _binary(keys), _binary(sketch)], ["id", "n", "d1", "d2", "keys", "sketch"])

    signed, _ = written(rows.mapInArrow(sign, "id long, n long, d1 long, d2 long, keys binary, sketch binary"), "signed")
    nodes = signed.where("id is not null and n > 0").groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes, _ = written(nodes, "nodes")

    # (table key, node) for every table; keys of one node drop out by a pre-aggregated count
    def tables(batches):
        pairs = np.array(banding.tables)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                keys = _matrix(part.column(1), np.uint64)
                with np.errstate(over="ignore"):
                    table = mix(keys[:, pairs[:, 0]] * np.uint64(0xA0761D6478BD642F) + keys[:, pairs[:, 1]] * np.uint64(0xE7037ED1A0B428DB) + np.arange(len(pairs), dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([_long(table.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), len(pairs))), pa.array(np.tile(np.arange(len(pairs), dtype=np.int16), part.num_rows))], ["key", "node", "t"])

    keyed = nodes.select("node", "keys").mapInArrow(tables, "key long, node long, t short")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members, members_path = written(keyed.join(shared, "key"), "members")
    leasts = members.groupBy("key").agg(F.min("node").alias("least"))

    def allowed(batches):
        for b in batches:
            apart = np.bitwise_count(_matrix(b.column(3), np.uint64) ^ _matrix(b.column(5), np.uint64)).sum(axis=1, dtype=np.int64) if b.num_rows else np.zeros(0, np.int64)
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            ok = _enough(na, nb, apart, percent)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[ok]), pa.array(b.column(1).to_numpy()[ok]), pa.array((apart / np.maximum(na + nb, 1))[ok])], ["a", "b", "far"])

    looks = nodes.select("node", "n", "sketch")
    stars = members.join(leasts, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    stars = stars.join(looks.toDF("a", "n_a", "s_a"), "a").join(looks.toDF("b", "n_b", "s_b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    ties, _ = written(stars.mapInArrow(allowed, "a long, b long, far double"), "ties")
    links = _confirmed(rows, ties, shingle, percent)
    labels = components(links)

    # buckets that hold several components: pairs across components, in blocks
    named = members.join(labels, "node", "left").select("key", "t", "node", "m", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = named.join(mixed, "key").join(nodes.select("node", "n", "keys", "sketch"), "node")
    parts_ = F.ceil(F.col("m") / block)
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("node"), parts_)).withColumn("other", F.explode(F.expr(f"sequence(0L, cast(ceil(m / {block}) as long) - 1)")))
    open_ = open_.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "t", "node", "label", "n", "keys", "sketch")
    open_ = open_.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def across(batches):
        for group in _groups(batches, 3):
            yield _across(group, banding, percent)

    more, _ = written(open_.mapInArrow(across, "a long, b long, far double"), "more-ties")
    removed(docs.sparkSession, members_path)
    if more.limit(1).count():
        links = links.union(_confirmed(rows, more, shingle, percent))
    final = components(links)

    ids = signed.select("id", "n", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"], "left")
    out = ids.join(final, "node", "left").withColumn("own", F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")))
    # rows that share an id are one document, so they share its least component
    twice = out.groupBy("id").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi")
    if twice.limit(1).count():
        tied = components(links.union(twice.select("lo", "hi")))
        out = ids.join(tied, "node", "left").withColumn("own", F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")))
        low = out.groupBy("id").agg(F.min("own").alias("own"))
        out = out.drop("own").join(low, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("own").alias("component_id"), F.coalesce(F.col("id") == F.col("own"), F.lit(True)).alias("kept"))


def _groups(batches, keys: int):
    """Record batches of whole groups; rows come sorted by the first ``keys`` columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        cols = [held.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(new):
            at = np.concatenate([[0], new])
            for x, y in zip(at[:-1], at[1:], strict=True):
                yield held.slice(int(x), int(y - x))
            held = held.slice(int(new[-1]))
    if held is not None:
        yield held


def _across(group: pa.Table, banding: Banding, percent: int) -> pa.RecordBatch:
    """Ties between components within one block pair of one bucket, each only in the first table that both ends share."""
    p, q, part, t, node, label, n = (group.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6, 7))
    keys, sketch = _matrix(group.column(8), np.uint64), _matrix(group.column(9), np.uint64)
    i, j = banding.tables[int(t[0])]
    found_a, found_b, found_far = [], [], []
    for x in range(len(node) - 1):
        y = np.arange(x + 1, len(node))
        y = y[(label[y] != label[x]) & ((part[y] != part[x]) | (p[x] == q[x]))]
        if not len(y):
            continue
        y = y[_enough(n[x], n[y], np.abs(n[y] - n[x]), percent)]
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        ok = _enough(n[x], n[y], apart, percent)
        y, apart = y[ok], apart[ok]
        if not len(y):
            continue
        same = keys[y] == keys[x]
        first = same.argmax(axis=1)
        same[np.arange(len(y)), first] = False
        own = (first == i) & (same.argmax(axis=1) == j)
        y, apart = y[own], apart[own]
        found_a.append(np.maximum(node[x], node[y]))
        found_b.append(np.minimum(node[x], node[y]))
        found_far.append(apart / (n[x] + n[y]))
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(found_a, np.int64)), pa.array(cat(found_b, np.int64)), pa.array(cat(found_far, float))], ["a", "b", "far"])


def _confirmed(rows: DataFrame, ties: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) links that the full sets confirm; enough of them for the components of all ties that hold."""
    active = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def gather(batches):
        for b in batches:
            for a, z, raw, offsets in parts(b.column(1)):
                row, value = word_shingles(raw, offsets, shingle)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=z - a))]) * 8
                sets = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), sets], ["node", "elements"])

    texts = among(rows, "id", active.select("node"))
    texts = texts.join(active, texts["id"] == active["node"]).select("node", "text")
    sets, sets_path = written(texts.mapInArrow(gather, "node long, elements binary"), "sets")

    def confirm(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[k] = len(x) + len(y) > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "linked"])

    left = ties.groupBy("a", "b").agg(F.min("far").alias("far"))
    left, left_path = written(left, "ties-left")
    links, done = None, 0
    while True:
        if done == 0:  # the nearest tie of each node
            pick = left.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
        elif done < 3:  # the nearest tie between each two components
            pick = left.groupBy("la", "lb").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("e")).select("e.a", "e.b")
        else:
            pick = left.select("a", "b")
        asked = among(sets, "node", pick.select(F.explode(F.array("a", "b")).alias("node")))
        both = pick.join(asked.toDF("a", "x"), "a").join(asked.toDF("b", "y"), "b").select("a", "b", "x", "y")
        checked, _ = written(both.mapInArrow(confirm, "a long, b long, linked boolean"), "checked")
        good = checked.where("linked").select("a", "b")
        links = good if links is None else links.union(good)
        labels = components(links)
        rest = left.select("a", "b", "far").join(checked.select("a", "b").distinct(), ["a", "b"], "left_anti")
        rest = rest.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        rest = rest.select("a", "b", "far", F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v")).where("u <> v")
        rest = rest.select("a", "b", "far", F.least("u", "v").alias("la"), F.greatest("u", "v").alias("lb"))
        last_path = left_path
        left, left_path = written(rest, "ties-left")
        removed(rows.sparkSession, last_path)
        done += 1
        if not left.limit(1).count():
            removed(rows.sparkSession, sets_path, left_path)
            return links
