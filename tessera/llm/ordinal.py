"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all grades and ordered thresholds t_0 < t_1 < ...; x are the
distinct hashed words, word beginnings and word endings of the whole text. The expected grade is the sum of the tail probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import LOWER, parts, prefix_hash, span_hash, words

#: Labelled rows that a fit uses at most: those of the smallest keyed hashes of their ids.
MAX_LABELLED = 12_000
BITS = 22
#: Bytes at the end of a word that make its second feature.
ENDING = 2
#: Bytes at the beginning of a word that make further features: inflected forms share them.
BEGINNINGS = (6,)
SLICE = 1 << 19
#: Chi-square that a feature needs.
TELLING = 100.0


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each row, sorted."""
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = prefix_hash(low)
    shift = np.uint64(64 - BITS)
    whole = (span_hash(prefix, starts, ends) >> shift).astype(np.int64)
    tail = (span_hash(prefix, np.maximum(starts, ends - ENDING), ends) * np.uint64(0xD1342543DE82EF95) >> shift).astype(np.int64)
    upper = np.add.reduceat((raw >= 65) & (raw <= 90), starts, dtype=np.int64)
    # words of capitals only share one feature
    loud = np.where((ends - starts > 2) & (2 * upper > ends - starts), 1, 0)
    heads = [span_hash(prefix, starts, np.minimum(starts + n, ends)) * np.uint64(2 * n + 1) >> shift for n in BEGINNINGS]
    key = np.concatenate([rows << BITS | whole, rows << BITS | tail, *(rows << BITS | h.astype(np.int64) for h in heads), rows[loud > 0] << BITS])
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def _telling(rows: np.ndarray, feats: np.ndarray, grades: np.ndarray, n_grades: int, least: float) -> np.ndarray:
    """Which features depend on some step between grades, by a chi-square with Yates' correction."""
    n, seen = len(grades), np.bincount(feats).astype(float)
    best = np.zeros(len(seen))
    for k in range(n_grades - 1):
        high = (grades > k).astype(float)
        a = np.bincount(feats, high[rows])
        b, c = seen - a, high.sum() - a
        d = n - seen - c
        off = np.maximum(np.abs(a * d - b * c) - n / 2, 0)
        best = np.maximum(best, n * off**2 / np.maximum(seen * (n - seen) * (a + c) * (b + d), 1))
    return best >= least


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Ordinal:
    """A fitted model: 2^BITS weights and one threshold for each step between grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    history: list[float] = field(default_factory=list)

    def tails(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each row and k."""
        count = np.bincount(rows, minlength=n)
        score = np.bincount(rows, self.weights[feats], minlength=n) / np.sqrt(np.maximum(count, 1)) ** DAMP
        return _sigmoid(score[:, None] - self.thresholds[None, :])


#: A text's score is divided by its number of features to half this power.
DAMP = 0.25


def fit(texts: pa.Array, grades: np.ndarray, **options) -> Ordinal:
    """Fit on texts at hand; see ``_fit``."""
    rows, feats = [], []
    for a, _, raw, offsets in parts(texts, SLICE):
        r, f = features(raw, offsets)
        rows.append(r + a)
        feats.append(f)
    return _fit(np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(feats or [np.zeros(0, np.int64)]), grades, **options)


def _fit(rows: np.ndarray, feats: np.ndarray, grades: np.ndarray, steps: int = 200, rate: float = 0.2, decay: float = 1e-5, telling: float = TELLING, n_grades: int = 2) -> Ordinal:
    """Maximum likelihood by Adam over all rows; features whose chi-square with every grade step is below ``telling`` keep
    weight 0, which keeps the many rare words from being learned by heart.

    There are ``n_grades`` grades at least, whether they occur or not: a step that no row decides has a threshold from its
    share clipped to 1 to 99 %. Without any row all weights are 0.
    """
    n_grades = max(n_grades, int(grades.max()) + 1) if len(grades) else n_grades
    n = len(grades)
    count = np.bincount(rows, minlength=n)
    scale = 1 / np.sqrt(np.maximum(count, 1)) ** DAMP
    known, feats = np.unique(feats, return_inverse=True)
    good = _telling(rows, feats, grades, n_grades, telling) if len(known) else np.zeros(0, bool)
    keep = good[feats]
    rows, feats, known = rows[keep], (np.cumsum(good) - 1)[feats[keep]], known[good]
    w = np.zeros(len(known))
    share = np.array([np.clip(np.mean(grades > k), 0.01, 0.99) if n else 0.5 for k in range(n_grades - 1)])
    t0 = -np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(t0), 0.1))
    theta = np.concatenate([t0[:1], gap])  # first threshold and log gaps, so the order holds by construction
    above = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    m, v, mt, vt, history = np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta), []
    for step in range(1, steps + 1 if n else 1):
        t = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        score = np.bincount(rows, w[feats], minlength=n) * scale
        p = _sigmoid(score[:, None] - t[None, :])
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        own = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        history.append(float(-np.log(own).mean()))
        # d log P(grade) / d z_k with z_k = score - t_k
        slope = p * (1 - p)
        lower = np.where(grades[:, None] - 1 == np.arange(n_grades - 1)[None, :], slope, 0.0)
        upper = np.where(grades[:, None] == np.arange(n_grades - 1)[None, :], slope, 0.0)
        gz = (lower - upper) / own[:, None] / n
        gw = -np.bincount(feats, (gz.sum(axis=1) * scale)[rows], minlength=len(w)) + decay * w
        gt = gz.sum(axis=0)
        gtheta = np.concatenate([[gt.sum()], [np.exp(theta[k]) * gt[k:].sum() for k in range(1, len(theta))]])
        for x, g, a, b in ((w, gw, m, v), (theta, gtheta, mt, vt)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = w
    return Ordinal(weights, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])), history)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating from two flags: 2 good, 1 poor but harmless, 0 toxic; null without a flag."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, most: int = MAX_LABELLED, seed: str = "ordinal",
          id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3) -> Ordinal:
    """Fit on the ``most`` labelled documents of smallest keyed hash (all of them if there are fewer).

    The executors turn texts into features; the driver gets those of ``most`` documents, at most 2^22 numbers each. A label
    that is repeated counts by its lowest grade, and a document that is repeated counts once, by its least text; labels
    without a document, a grade or an id count nothing. The model always has ``n_grades`` grades: those that no label has
    become improbable, and without any label all weights are 0 and the tails only differ by step. Other columns are
    ignored, whatever their names. Texts may be of any length.
    """
    grade = grade_of(F.col("quality"), F.col("toxic")) if grade is None else grade
    rated = labels.select(F.col(f"`{id_col}`").alias("__id"), grade.cast("int").alias("__g"))
    rated = rated.where("__g is not null and __id is not null").groupBy("__id").agg(F.min("__g").alias("__g"))
    rated = rated.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "__id")), "__id").limit(most)
    some = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")).join(F.broadcast(rated), "__id")  # bounded by `most`
    some = some.groupBy("__id").agg(F.min("__t").alias("__t"), F.first("__g").alias("__g"))

    def run(batches):
        for b in batches:
            for a, z, raw, offsets in parts(b.column(0), SLICE):
                r, f = features(raw, offsets)
                cut = np.searchsorted(r, np.arange(z - a + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32())), b.column(1).slice(a, z - a), b.column(2).slice(a, z - a)], ["f", "g", "i"])

    got = some.select("__t", "__g", "__id").mapInArrow(run, "f array<int>, g int, i long").toArrow()
    got = got.sort_by("i")
    lists = got.column("f").combine_chunks()
    grades = got.column("g").to_numpy().astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    return _fit(np.repeat(np.arange(len(grades)), sizes), lists.flatten().to_numpy().astype(np.int64), grades, n_grades=n_grades)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail`` (probabilities of exceeding grade 0, 1, ...).

    Null and empty texts have no features: they get the prior of the thresholds. Repeated rows score alike. Columns named
    as a result column are replaced. The model's size is fixed (2^22 weights), whatever the corpus.
    """
    cols = [c for c in docs.columns if c.lower() not in ("expected_grade", "tail")]
    df = docs.select(*[f"`{c}`" for c in cols])
    place, held = cols.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for b in batches:
            tails = [own.tails(*features(raw, offsets), z - a) for a, z, raw, offsets in parts(b.column(place), SLICE)]
            t = np.concatenate(tails or [np.zeros((0, len(own.thresholds)))])
            cut = np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t.sum(axis=1)), pa.ListArray.from_arrays(pa.array(cut), pa.array(t.ravel()))], [*cols, "expected_grade", "tail"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, expected_grade double, tail array<double>")


def select(scored: DataFrame, above: int, least: float = 0.5) -> DataFrame:
    """``scored`` with ``kept``: P(grade > ``above``) is ``least`` or more."""
    return scored.withColumn("kept", F.element_at("tail", above + 1) >= least)
