"""Suffix-array dedup: bytes of long strings that start earlier in the corpus are removed.

The suffix arrays are built by grouping in linear time: groups of suffixes are taken in descending order, the
previous-smaller pointers of their members move earlier suffixes into higher groups until each group shares its Lyndon
prefix, and one ascending pass over the pointers emits each group's order, with no recursive renaming.

To keep suffix arrays small and independent, the corpus is cut by content. Each string of ``length`` bytes has an anchor,
its least k-gram by hash; strings of neighbouring starts with one anchor make a run. Equal strings have equal anchors, so
a string can only repeat among the runs of its anchor. Runs of equal bytes are settled by a pre-aggregated minimum;
where an anchor has several different runs (the edges of repeated passages), their bytes go into one suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import mix, parts, prefix_hash, span_hash, window_hash, written

#: Bytes of an anchor.
GRAM = 40
#: Runs that a task holds before it emits them, each distinct run once.
HELD_RUNS = 1_000_000
#: Different runs of one anchor that go into one suffix array; the strings of a fuller anchor are dealt out by hash.
ARRAY_RUNS = 2_000
#: A group of full copies is large if it has more than this part of them; there are fewer such groups than this.
MOST_LARGE = 10_000


def suffix_array(text: list[int] | bytes) -> list[int]:
    """The suffix array of a sequence of small integers, by linear grouping."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # buckets by first symbol; a group is an interval of `order`, named by its start
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for at, suffix in enumerate(order):
        if text[suffix] != text[order[start]]:
            end[start] = at
            start = at
        place[suffix], group[suffix] = at, start
    end[start] = n
    previous, top = [-1] * n, n
    while top:
        low = group[order[top - 1]]
        members = sorted(order[low:top])
        count: dict[int, int] = {}
        for suffix in members:
            j = suffix - 1
            while j >= 0 and group[j] >= low:
                j = previous[j]
            previous[suffix] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            levels: dict[int, list[int]] = {}
            for j, times in count.items():
                levels.setdefault(times, []).append(j)
            for times in sorted(levels, reverse=True):
                moved: dict[int, list[int]] = {}
                for j in levels[times]:
                    moved.setdefault(group[j], []).append(j)
                for old, some in moved.items():
                    stop = end[old]
                    new = stop - len(some)
                    at = stop - 1
                    for j in some:  # to the end of the old group's interval
                        other, here = order[at], place[j]
                        order[here], place[other] = other, here
                        order[at], place[j] = j, at
                        at -= 1
                    if new > old:
                        end[old], end[new] = new, stop
                        for j in some:
                            group[j] = new
        top = low
    # emit: a suffix that starts where earlier ones' Lyndon prefixes end puts them next in their groups
    out, slot, placed = [-1] * n, list(range(n)), [False] * n
    for at in range(-1, n):
        j = (out[at] if at >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = True
            j = previous[j]
    return out


def repeats(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Strings of ``length`` bytes that occur twice or more: their (piece, offset) places, from a suffix array."""
    text: list[int] = []
    piece, offset = [], []
    for k, p in enumerate(pieces):
        text += p
        text.append(256)
        piece += [k] * (len(p) + 1)
        offset += range(len(p) + 1)
    raw, out, now, last = b"".join(p + b"\0" for p in pieces), [], [], b""
    for at in suffix_array(text):
        k = piece[at]
        if offset[at] + length > len(pieces[k]):
            continue
        window = raw[at : at + length]
        if window != last:
            if len(now) > 1:
                out.append(now)
            now, last = [], window
        now.append((k, offset[at]))
    if len(now) > 1:
        out.append(now)
    return out


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, strings, anchor, content) of the runs: ``strings`` consecutive starts whose anchor is one k-gram."""
    none = np.zeros(0, np.int64)
    n = len(raw) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(raw)
    grams = window_hash(prefix, gram)
    width = length - gram + 1
    # least (hash, place) of each `width` k-grams: prefix minima of blocks from both sides
    value = grams >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 24) - 1)
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(value)] = value
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    sizes = np.diff(offsets)
    whole = np.zeros(len(raw) + 1, np.int32)
    fits = np.flatnonzero(sizes >= length)
    np.add.at(whole, offsets[fits], 1)
    np.add.at(whole, offsets[fits + 1] - length + 1, -1)
    valid = np.cumsum(whole[:n]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    head = np.zeros(len(raw) + 1, bool)
    head[offsets[:-1]] = True
    new |= valid & head[:n]
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    stop = np.flatnonzero(last)
    low = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    anchor_at = start + ((low - start) & ((1 << 24) - 1))
    row = np.searchsorted(offsets, start, "right") - 1
    content = span_hash(prefix, start, stop + length)
    # the anchor's place in the run belongs to its content
    return row, start - offsets[row], stop - start + 1, grams[anchor_at], mix(content + (anchor_at - start).astype(np.uint64))


RUNS = "anchor long, content long, id long, start long, strings long"


def _combined(anchor, content, ident, start, strings, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the first of each equal run; and the spans (id, start, stop) of the others. A repeated row's run is the first itself."""
    order = np.lexsort((start, ident, content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    rest = order[(ident[order] != ident[lead]) | (start[order] != start[lead])]
    return order[first], ident[rest], start[rest], start[rest] + strings[rest] - 1 + length


def _merged(ident: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one id as one."""
    if not len(ident):
        return ident, start, stop
    order = np.lexsort((stop, start, ident))
    ident, start, stop = ident[order], start[order], stop[order]
    _, group = np.unique(ident, return_inverse=True)
    shift = group * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(ident), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ident[at], start[at], (reach - shift)[np.append(at[1:], len(ident)) - 1]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names.split())


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of a corpus.

    ``documents``: (doc_id, text, n_bytes, copy) with texts as UTF-8 bytes; ``copy`` marks texts of ``length`` bytes or more
    that a smaller doc_id has in full. ``spans``: (doc_id, spans) with the maximal removed runs of the other documents that
    have any. A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of
    smaller id, or earlier in the same one. Strings never cross documents and are judged on the input. A null text is
    empty. Rows that share an id are taken to be equal and get equal results: none makes the other's strings repeats. A row
    without an id is left whole and makes no other row's strings repeats. Other columns are ignored, whatever their names;
    an empty table gives empty results. A text of any length is cut and fetched whole by one task.
    """
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text"))
    rows = every.where("id is not null")
    # full copies: a digest's least id
    seen = rows.where(F.length("text") >= length).select("id", F.sha2("text", 256).alias("digest"))
    firsts, _ = written(seen.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copied = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # groups of more than a share of all copies are few whatever the corpus, and need no task of their own
    large = F.broadcast(firsts.where(F.col("n") * MOST_LARGE > copied).select("digest", "first"))
    small = firsts.where(F.col("n") * MOST_LARGE <= copied).select("digest", "first")
    matched = seen.join(large, "digest").unionByName(seen.join(large.drop("first"), "digest", "left_anti").join(small, "digest"))
    copies, _ = written(matched.where("id <> first").select("id").distinct(), "copies")

    def cut(batches):
        held: list[tuple] = []
        total = 0

        def emit() -> Iterator[pa.RecordBatch]:
            anchor, content, ident, start, strings = (np.concatenate([h[k] for h in held]) for k in range(5))
            keep, i, s, t = _combined(anchor, content, ident, start, strings, length)
            for k in range(0, len(keep), 200_000):
                some = keep[k : k + 200_000]
                yield _batch("anchor content id start strings", anchor[some], content[some], ident[some], start[some], strings[some])
            i, s, t = _merged(i, s, t)
            if len(i):  # settled here: carried along with a start below zero
                yield _batch("anchor content id start strings", mix(i.view(np.uint64) + np.uint64(3)), t, i, -1 - s, np.zeros(len(i), np.int64))

        for b in batches:
            ids = b.column(0).to_numpy()
            for a, _, raw, offsets in parts(b.column(1), 1 << 20):
                row, start, strings, anchor, content = runs(raw, offsets, length)
                if len(row):
                    held.append((anchor, content, ids[a + row], start, strings))
                    total += len(row)
                    if total >= HELD_RUNS:
                        yield from emit()
                        held, total = [], 0
        if held:
            yield from emit()

    fresh = rows.join(copies, "id", "left_anti")
    dealt = fresh.mapInArrow(cut, RUNS).repartition("anchor").sortWithinPartitions("anchor", "content", "id", "start")

    def settle(batches):
        for t in _anchor_groups(batches):
            anchor, content, ident, start, strings = (t.column(k).to_numpy() for k in range(5))
            done = start < 0
            spans = [(ident[done], -1 - start[done], content[done])]
            live = np.flatnonzero(~done)
            anchor, content, ident, start, strings = (x[live] for x in (anchor, content, ident, start, strings))
            keep, i, s, e = _combined(anchor, content, ident, start, strings, length)
            spans.append((i, s, e))
            anchor, ident, start, strings = (x[keep] for x in (anchor, ident, start, strings))
            _, at, many = np.unique(anchor, return_inverse=True, return_counts=True)
            several = many[at] > 1
            i, s, e = _merged(*(np.concatenate([x[k] for x in spans]) for k in range(3)))
            zero = np.zeros(len(i), np.int64)
            yield _batch("kind anchor id start stop runs", np.zeros(len(i), np.int64), zero, i, s, e, zero)
            n = int(several.sum())
            yield _batch("kind anchor id start stop runs", np.ones(n, np.int64), anchor[several], ident[several], start[several], (start + strings - 1 + length)[several], many[at][several])

    settled, _ = written(dealt.mapInArrow(settle, "kind long, anchor long, id long, start long, stop long, runs long"), "settled")
    wanted = settled.where("kind = 1").groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "stop", "runs")).alias("want"))
    bits = rows.join(wanted, "id").select("id", "text", "want")

    def fetch(batches):
        for b in batches:
            rows_out: list[tuple] = []
            for ident, text, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for w in want:
                    if w["runs"] <= ARRAY_RUNS:
                        rows_out.append((w["anchor"], 0, ident, w["start"], data[w["start"] : w["stop"]]))
                    else:  # a fuller anchor: its strings one by one, dealt out by hash
                        deal = -(-w["runs"] * length // ARRAY_RUNS)
                        for at in range(w["start"], w["stop"] - length + 1):
                            piece = data[at : at + length]
                            rows_out.append((w["anchor"], 1 + int.from_bytes(hashlib.blake2b(piece, digest_size=7).digest(), "big") % deal, ident, at, piece))
                if len(rows_out) > 20_000:
                    yield _pieces(rows_out)
                    rows_out = []
            if rows_out:
                yield _pieces(rows_out)

    pieces = bits.mapInArrow(fetch, "anchor long, deal long, id long, start long, piece binary")
    # equal pieces under one anchor: only the earliest can be first, and pre-aggregation drops the rest before the shuffle
    least = pieces.groupBy("anchor", "deal", "piece").agg(F.min(F.struct("id", "start")).alias("m"), F.count("*").alias("n"))
    least = least.select("anchor", "deal", "m.id", "m.start", "piece", "n").repartition("anchor", "deal").sortWithinPartitions("anchor", "deal")

    def arrays(batches):
        for t in _anchor_groups(batches, 2):
            i, s, e = _edges(t, length)
            yield _batch("id start stop", i, s, e)

    edges = least.mapInArrow(arrays, "id long, start long, stop long")
    # strings dealt out one by one also repeat as wholes, after the least
    single = pieces.where("deal > 0").select("anchor", "deal", "piece", "id", "start")
    again = single.join(least.where("deal > 0 and n > 1").select("anchor", "deal", "piece", F.col("id").alias("i0"), F.col("start").alias("s0")), ["anchor", "deal", "piece"])
    again = again.where("id <> i0 or start <> s0").select("id", "start", (F.col("start") + length).alias("stop"))
    spans = settled.where("kind = 0").select("id", "start", "stop").unionByName(edges).unionByName(again)
    spans = spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    documents = every.join(copies.withColumn("copy", F.lit(True)), "id", "left").select("id", "text", F.length("text").cast("long").alias("n_bytes"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return documents, spans


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.binary())], ["anchor", "deal", "id", "start", "piece"])


def _anchor_groups(batches, keys: int = 1) -> Iterator[pa.Table]:
    """Tables that hold whole groups, many at a time; rows come sorted by the first ``keys`` columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < 20_000:
            continue
        held = held.combine_chunks()
        cols = [held.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(new):
            yield held.slice(0, int(new[-1]))
            held = held.slice(int(new[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _edges(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of repeated strings among the pieces of each anchor of a table."""
    anchor, deal, ident, start = (t.column(k).to_numpy() for k in range(4))
    pieces = t.column(4).to_pylist()
    group = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (deal[1:] != deal[:-1]))])
    # strings whose hash is alone in its group cannot repeat: only stretches of the others go into the suffix array
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    hashes = window_hash(prefix_hash(raw), length)
    strings = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), strings)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    value = mix(hashes[offsets[owner] + within] + group[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    ranked = value[order]
    twin = np.zeros(len(value), bool)
    equal = ranked[1:] == ranked[:-1]
    twin[order[1:]] |= equal
    twin[order[:-1]] |= equal
    at = np.flatnonzero(twin)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (within[at[1:]] != within[at[:-1]] + 1)
    begin = np.flatnonzero(new)
    close = np.append(begin[1:], len(at)) - 1
    stretch = [(int(owner[at[x]]), int(within[at[x]]), int(within[at[y]]) + length) for x, y in zip(begin, close, strict=True)]
    i, s, e = [], [], []
    k = 0
    while k < len(stretch):
        g, z = group[stretch[k][0]], k
        while z < len(stretch) and group[stretch[z][0]] == g:
            z += 1
        own = stretch[k:z]
        for places in repeats([pieces[o][a:b] for o, a, b in own], length):
            where = sorted((int(ident[own[p][0]]), int(start[own[p][0]]) + own[p][1] + off) for p, off in places)
            for d, x in where[1:]:
                i.append(d)
                s.append(x)
                e.append(x + length)
        k = z
    return _merged(np.array(i, np.int64), np.array(s, np.int64), np.array(e, np.int64))


def kept(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document; ``kept`` are the remaining bytes."""
    joined = documents.join(spans, "id", "left").select("id", "text", "n_bytes", "copy", "spans")

    def run(batches):
        for b in batches:
            removed_, count, digest, left = [], [], [], []
            for text, n, copy, own in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                out, at, gone, many = [], 0, 0, 0
                for a, z in [(0, n)] if copy else _union(own):
                    out.append(data[at:a])
                    at, gone, many = z, gone + z - a, many + 1
                out.append(data[at:])
                rest = b"".join(out)
                removed_.append(gone)
                count.append(many)
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(removed_, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]
