"""Benchmark decontamination: q-gram lemma filter over overlapping diagonal bands, verified by banded alignment.

Texts and items are lower-cased and every white-space character counts as a blank. An item of n characters with an edit
budget e shares at least n - q + 1 - q * e of its q-grams with any passage within e edits of it, and their diagonals lie
within e of each other. Each document is filtered in three exact steps: q-grams that occur in no item go; positions that
no window has enough hits around go; (item, band) pairs below the bound go. Banded alignment settles what is left. Items
too short for a q-gram are looked up as whole words, by hash and then letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import mix, parts, powers, removed, written

#: Characters of items that one pass over the documents holds as an index; more items take more passes.
INDEX_CHARS = 8_000_000
_BITS = 22
#: Bytes of text that are hashed at a time, few enough for the processor's cache.
SLICE = 1 << 18

_table: list[np.ndarray] = []


def _codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, blanks made equal, and the row offsets in code points."""
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(codes <= 32, np.uint32(32), codes), heads[offsets]


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    if not _table:
        _table.append(mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(77)))
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_table[0][codes] * up[: len(codes)], out=prefix[1:])
        return (prefix[q:] - prefix[:n]) * down[:n]


@dataclass(frozen=True)
class Budget:
    """q-gram length and the edit budget: at most ``rate`` edits a character, and few enough for the lemma to bite."""

    q: int = 12
    rate: float = 0.05
    #: Items of fewer characters are left out: raise it if the items hold bare answers such as ``yes``.
    shortest: int = 1

    def edits(self, n: int) -> int:
        return max(0, min(int(self.rate * n), (n - self.q) // self.q - 1))

    def least(self, n: int) -> int:
        return n - self.q + 1 - self.q * self.edits(n)


class Index:
    """The q-grams of a set of items."""

    def __init__(self, items: Iterable[tuple[int, str]], budget: Budget) -> None:
        self.budget, self.ids, self.codes = budget, [], []
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for key, text in items:
            low = pc.utf8_lower(pa.array([(text or "").strip()]))[0].as_py().encode()
            codes, _ = _codes(np.frombuffer(low, np.uint8), np.array([0, len(low)]))
            if len(codes) >= budget.q:
                self.ids.append(key)
                self.codes.append(codes)
            elif len(codes) >= max(1, budget.shortest):
                self.short.setdefault(len(codes), {}).setdefault(int(_grams(codes, len(codes))[0]), []).append((key, codes))
        grams = [_grams(c, budget.q) for c in self.codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(value, kind="stable")
        self.item, self.place, value = item[order], place[order], value[order]
        self.value, self.first = np.unique(value, return_index=True)
        self.first = np.append(self.first, len(value))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.value >> np.uint64(64 - _BITS)] = True
        n = np.array([len(c) for c in self.codes], np.int64)
        self.n, self.e = n, np.array([budget.edits(x) for x in n], np.int64)
        self.least = np.array([budget.least(x) for x in n], np.int64)
        self.band = 2 * self.e + 1
        self.scan = (int(self.least.min()), int((n + 2 * self.e).max())) if len(n) else (1, 1)

    def hits(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item id, start, stop, edits, item length) of each occurrence in a chunk of texts."""
        found = [(r, self.ids[i], s, t, e, int(self.n[i])) for r, i, s, t, e in self._near(codes, offsets)]
        return found + list(self._whole(codes, offsets)) if self.short else found

    def _whole(self, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Short items that stand as whole words."""
        gap = np.append(codes == 32, True)
        gap_before = np.concatenate([[True], gap[:-1]])
        gap_before[offsets[:-1][offsets[:-1] < len(gap_before)]] = True
        ends = np.zeros(len(codes) + 1, bool)
        ends[offsets] = True
        ends |= gap
        for n, items in self.short.items():
            grams = _grams(codes, n)
            at = np.flatnonzero(gap_before[: len(grams)] & ends[n : n + len(grams)])
            at = at[np.isin(grams[at], np.fromiter(items, np.uint64, len(items)))]
            rows = np.searchsorted(offsets, at, "right") - 1
            for k, row in zip(at.tolist(), rows.tolist(), strict=True):
                if k + n <= offsets[row + 1]:
                    for key, own in items[int(grams[k])]:
                        if (codes[k : k + n] == own).all():
                            yield row, key, int(k - offsets[row]), int(k - offsets[row] + n), 0, n

    def _near(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, stop, edits) of the items that have q-grams."""
        q = self.budget.q
        if not self.ids or len(codes) < q:
            return []
        grams = _grams(codes, q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - _BITS)])
        known = np.minimum(np.searchsorted(self.value, grams[at]), len(self.value) - 1)
        real = self.value[known] == grams[at]
        at, known = at[real], known[real]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + q <= offsets[row + 1]
        at, known, row = at[inside], known[inside], row[inside]
        need, width = self.scan
        if len(at) < need:
            return []
        # a hit stays if some run of `need` hits around it lies in one row and within `width` characters
        tight = np.flatnonzero((at[need - 1 :] - at[: len(at) - need + 1] <= width) & (row[need - 1 :] == row[: len(at) - need + 1]))
        if not len(tight):
            return []
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, tight, 1)
        np.add.at(cover, tight + need, -1)
        dense = np.cumsum(cover[:-1]) > 0
        at, known, row = at[dense], known[dense], row[dense]

        many = self.first[known + 1] - self.first[known]
        which = np.repeat(self.first[known], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, row, at = self.item[which], np.repeat(row, many), np.repeat(at, many)
        diagonal = at - offsets[row] - self.place[which]
        band = np.floor_divide(diagonal, self.band[item])
        row, item = np.concatenate([row, row]), np.concatenate([item, item])
        band = np.concatenate([band, band - 1])  # band b holds the diagonals from b to b + 2 widths
        order = np.lexsort((band, item, row))
        row, item, band = row[order], item[order], band[order]
        edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        count = np.diff(np.append(edge, len(row)))
        edge = edge[count >= self.least[item[edge]]]
        return list(self._verified(codes, offsets, row[edge], item[edge], band[edge]))

    def _verified(self, codes, offsets, rows, items, bands) -> Iterator[tuple[int, int, int, int, int]]:
        at = 0
        while at < len(rows):
            row, item = int(rows[at]), int(items[at])
            n, e, wide = int(self.n[item]), int(self.e[item]), int(self.band[item])
            lo, hi = int(bands[at]) * wide, (int(bands[at]) + 2) * wide - 1
            at += 1
            while at < len(rows) and rows[at] == row and items[at] == item and int(bands[at]) * wide <= hi:
                hi = (int(bands[at]) + 2) * wide - 1
                at += 1
            text = codes[offsets[row] : offsets[row + 1]]
            for start, stop, edits in align(self.codes[item], text, lo - e, hi + e, e):
                yield row, item, start, stop, edits


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, budget: int) -> list[tuple[int, int, int]]:
    """(start, stop, edits) of disjoint passages of ``text`` within ``budget`` edits of ``item``, best first.

    Diagonals (text position less item position) run from lo to hi; the passage may begin and end anywhere in the band.
    """
    n, m = len(item), len(text)
    width = hi - lo + 1
    big = n + width + 1
    k = np.arange(width)
    cost = np.where((k + lo >= 0) & (k + lo <= m), 0, big)  # before any item character, at text position k + lo
    start = k + lo
    padded = np.full(width + n, np.uint32(0xFFFFFFFF))
    a, b = max(0, lo), min(m, hi + n)
    if b > a:
        padded[a - lo : b - lo] = text[a:b]
    for i in range(n):
        here = k + lo + i  # text position of diagonal k before character i of the item
        same = padded[i : i + width] != item[i]
        step = np.where((here >= 0) & (here < m), cost + same, big)  # match or substitute
        skip = np.append(cost[1:], big) + 1  # item character left out
        s_skip = np.append(start[1:], 0)
        s = np.where(step <= skip, start, s_skip)
        c = np.minimum(step, skip)
        c = np.where((here + 1 >= 0) & (here + 1 <= m), c, big)
        run = np.minimum.accumulate(c - k)  # text characters put in
        better = run + k < c
        if better.any():
            source = np.maximum.accumulate(np.where(c - k == run, k, 0))
            s = np.where(better, s[source], s)
            c = np.where(better & (here + 1 <= m), run + k, c)
        cost, start = c, s
    ends, out = k + lo + n, []
    left = (cost <= budget) & (ends >= 0) & (ends <= m)
    while left.any():
        best = int(np.argmin(np.where(left, cost, big)))
        s, t, c = int(start[best]), int(ends[best]), int(cost[best])
        out.append((s, t, c))
        left &= (start >= t) | (ends <= s)
    return out


SCHEMA = "doc_id long, item_id long, start long, stop long, edits long, item_chars long, similarity double"


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", budget: Budget = Budget()) -> DataFrame:
    """One row for each passage of a document within the edit budget of an item.

    ``start`` and ``stop`` are characters of the lower-cased text. Items shorter than q characters match as whole words,
    without edits; null and blank items match nothing; null and empty documents have no hits; repeated documents and
    repeated items each have their own rows, and of passages that overlap for one item the best stays, the earlier one on
    a tie. Other columns are ignored, whatever their names; an empty table gives an empty result. A text may be of any
    length: it is held whole by one task, with a few arrays of its size.
    Items are indexed in shards of at most about ``INDEX_CHARS`` characters, one pass over the documents each, and a
    shard's index is built anew for its pass, so what driver and tasks hold is bounded whatever the number of items.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for index, shards in _indexes(items, item_id, item_text, budget):
        found, held = _scan(rows, index)
        if shards > 1:  # settled before the next index is made
            found, _ = written(found, "hits")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(items: DataFrame, item_id: str, item_text: str, budget: Budget) -> Iterator[tuple[Index, int]]:
    keyed = items.select(F.col(f"`{item_id}`").cast("long").alias("k"), F.col(f"`{item_text}`").alias("t")).where(F.col("t").isNotNull())
    total = keyed.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = -(-total // INDEX_CHARS) or 1
    for shard in range(shards):
        some = keyed if shards == 1 else keyed.where(F.pmod(F.xxhash64("k", "t"), F.lit(shards)) == shard)
        yield Index(sorted(((r["k"], r["t"]) for r in some.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), budget), shards


def _scan(rows: DataFrame, index: Index):
    held = rows.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        own = held.value
        for batch in batches:
            low = pc.utf8_lower(batch.column(1))
            found = []
            for a, _, raw, offsets in parts(low, SLICE):
                codes, at = _codes(raw, offsets)
                found += [(a + hit[0], *hit[1:]) for hit in own.hits(codes, at)]
            if found:
                row = pa.array([x[0] for x in found])
                n = [x[5] for x in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3, 4)),
                    pa.array(n, pa.int64()), pa.array([1 - x[4] / k for x, k in zip(found, n, strict=True)], pa.float64()),
                ], ["doc_id", "item_id", "start", "stop", "edits", "item_chars", "similarity"])

    return rows.mapInArrow(scan, SCHEMA), held


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", budget: Budget = Budget()) -> DataFrame:
    """The rows of ``docs`` that hold no passage within the edit budget of an item; one pass a shard, no shuffle.

    Rows are judged on their text alone, whatever their id; null and empty texts stay, repeated rows stay or go together,
    and all columns pass through, whatever their names. An empty table stays empty.
    """
    place, last = docs.columns.index(text_col), None
    for index, shards in _indexes(items, item_id, item_text, budget):
        docs, held = _without(docs, index, place)
        if shards > 1:
            docs, path = written(docs, "without-hits")
            held.destroy()
            if last:
                removed(docs.sparkSession, last)
            last = path
    return docs


def _without(docs: DataFrame, index: Index, place: int):
    held = docs.sparkSession.sparkContext.broadcast(index)

    def drop(batches):
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for a, _, raw, offsets in parts(pc.utf8_lower(batch.column(place)), SLICE):
                codes, at = _codes(raw, offsets)
                for hit in held.value.hits(codes, at):
                    stay[a + hit[0]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(drop, docs.schema), held
