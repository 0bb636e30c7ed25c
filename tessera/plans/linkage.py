"""The whole linkage: views, blocking, features, scores, decisions, and the runs around them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.views import record_views
from tessera.operators import decide, grid, matcher
from tessera.operators.blocking import Blocking
from tessera.operators.features import SCORED, pair_features
from tessera.sources import records as io
from tessera.sources.tables import table

#: Features of the matcher, in model order: string scores, flags, house numbers, blocking, and those within a query.
FEATURES = [
    *[name for name, _, _ in SCORED], "alias_best", "init_match", "n_core_exact", "n_first_eq", "legal_same", "legal_conflict", "num_exact", "q_has_num", "c_has_num", "postal_eq", "postal_conflict",
    "unit_eq", "unit_conflict", "q_ncomp", "c_ncomp", "c_addr_missing", "c_fixed", "q_deva", "c_deva", "cross_script", "q_ntok", "c_ntok", "len_ratio", "is_s3", "hn_both", "hn_eq", "hn_absdiff", "hn_reldiff",
    "hn_lev", "hn_trunc", "blk", "ncos", "acos", "rank", "in_name", "n_cand", "blk_rel", "blk_gap", "name_gap", "addr_gap",
]
#: Thresholds that tuning tries, and those whose match lists are kept.
GRID = [round(0.1 + 0.025 * k, 3) for k in range(35)]
VARIANTS = [0.70, 0.75, 0.80, 0.85, 0.90]
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Linkage:
    blocking: Blocking = field(default_factory=Blocking)
    threshold: float = 0.75
    cap: int = 15
    resolve: bool = True
    states: bool = False
    streets: bool = False
    placeholders: bool = False
    by_sound: bool = False
    mend: bool = False

    def switches(self) -> dict[str, bool]:
        return {name: getattr(self, name) for name in ("states", "streets", "placeholders", "by_sound", "mend")}

    def with_overrides(self, given: dict | str) -> Linkage:
        """This plan with some settings changed, from a dictionary or JSON; settings of ``blocking`` may stand beside the others."""
        given = json.loads(given) if isinstance(given, str) else dict(given)
        inner = {f.name for f in fields(Blocking)}
        unknown = set(given) - inner - {f.name for f in fields(Linkage)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        block = replace(self.blocking, **{k: v for k, v in given.items() if k in inner})
        return replace(self, blocking=block, **{k: v for k, v in given.items() if k not in inner and k != "blocking"})


def views(records: DataFrame, plan: Linkage) -> DataFrame:
    """All views of records (id, name, address, country)."""
    return record_views(records, **plan.switches())


def stored_views(records: DataFrame, plan: Linkage, root: str) -> DataFrame:
    """The view table of these records under ``root``, made at the first call with these switches."""
    path = io.write_views(views(records, plan), root, plan.switches(), records.count())
    return io.read_views(records.sparkSession, path)


def blocked(seen: DataFrame, plan: Linkage) -> DataFrame:
    """Candidates of views, by core name and plain address."""
    base = seen.select("country", "id", "is_query", F.col("name_core").alias("name"), F.col("addr_plain").alias("addr"))
    return grid.candidates(base, {"name": "name", "addr": "addr"}, plan.blocking)


def staged(seen: DataFrame, plan: Linkage, truth: DataFrame | None = None) -> DataFrame:
    """Candidates with every feature, and the label ``y`` if ``truth`` (q, c) is given, as a written table."""
    pairs = pair_features(blocked(seen, plan), seen)
    if truth is not None:
        pairs = pairs.join(truth.select("q", "c", F.lit(1).alias("y")).distinct(), ["q", "c"], "left").na.fill(0, ["y"])
    return table(pairs, "pairs")


def entities(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, country, tsize) of every query; singletons have size 0."""
    sizes = truth.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("tsize"))
    out = records.where("is_query").select("id", "country").join(sizes, "id", "left")
    return out.select(F.col("id").alias("q"), "country", F.coalesce("tsize", F.lit(0)).cast("long").alias("tsize"))


def link(records: DataFrame, plan: Linkage, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """(candidates with p, decided pairs) of records (id, is_query, name, address, country); ``scorer`` adds p to features."""
    scored = scorer(staged(table(views(records, plan), "views"), plan))
    return scored, decide.decide(scored, plan.threshold, plan.cap, plan.resolve)


def fit_and_validate(pairs: DataFrame, known: DataFrame, asked: DataFrame, weights: DataFrame | None = None, rounds: int = 100, depth: int = 5, cap: int = 15) -> dict:
    """Train on the pairs of the queries ``known`` (entities), judge those of ``asked``.

    The result holds the model, the scored pairs of ``asked``, the tuned threshold, the macro means with and without the
    many-to-one step, and the features that gain most.
    """
    model = matcher.train(pairs.join(known.select("q"), "q", "left_semi"), FEATURES, rounds, depth)
    scored = table(matcher.predict(pairs.join(asked.select("q"), "q", "left_semi"), model, FEATURES).select("country", "q", "c", "p", "y"), "scored")
    best = decide.tuned(decide.threshold_grid(scored, asked, GRID, cap, weights)).first()
    judged = {f"resolve_{r}".lower(): decide.report(decide.entity_scores(decide.decide(scored, best["thr"], cap, r), asked)).first().asDict() for r in (True, False)}
    return {"model": model, "scored": scored, "threshold": best["thr"], "f05_testmix": best["f05_testmix"], **judged, "gains": matcher.gains(model, FEATURES)}


def mini(spark: SparkSession, records: DataFrame, truth: DataFrame, overrides: dict | str = "{}", **fit) -> dict:
    """One run on a small world under changed settings: half of the queries train, the other half validate."""
    from tessera.operators.sampling import unit_hash

    plan = Linkage().with_overrides(overrides)
    pairs, all_ = staged(table(views(records, plan), "views"), plan, truth), entities(records, truth)
    half = unit_hash(F.col("q"), "half") < 0.5
    return {"plan": asdict(plan), **fit_and_validate(pairs, all_.where(half), all_.where(~half), cap=plan.cap, **fit)}


def match_lists(scored: DataFrame, queries: DataFrame, threshold: float, cap: int = 15, resolve: bool = True) -> DataFrame:
    """(q, matched_ids): a row for each query, best match first."""
    return decide.lists(decide.decide(scored, threshold, cap, resolve), queries, [(-F.col("p")).alias("o"), F.col("c").alias("o2")], "matched_ids")


def variants(scored: DataFrame, queries: DataFrame, thresholds: list[float], cap: int = 15, q_order: str = "q", c_order: str = "c") -> DataFrame:
    """(thr, q, matched_ids) for several thresholds, from one decision at the lowest one and one list a query."""
    once = decide.decide(scored, min(thresholds), cap, True, q_order, c_order)
    steps = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])).alias("thr")
    made = once.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("c").cast("string").alias("c")))).alias("l"))
    each = queries.select("q").join(made, "q", "left").select("q", "l", steps)
    kept = F.transform(F.filter("l", lambda x: -x["o"] >= F.col("thr")), lambda x: x["c"])
    return each.select("thr", "q", F.coalesce(F.array_join(kept, ","), F.lit("")).alias("matched_ids"))


def write_outputs(scored: DataFrame, queries: DataFrame, plan: Linkage, root: str) -> dict:
    """Scores, candidate lists, match lists and threshold variants of a run under ``root``; counts and violations.

    ``queries`` (q, row_idx) orders the lists. Scores are written first, and matches decided from what was written, so that
    ``rethreshold`` gives the same lists later.
    """
    spark = scored.sparkSession
    io.write_scores(scored, f"{root}/scores")
    cands = decide.lists(scored, queries, [F.col("c").alias("o")], "candidate_ids").join(queries, "q")
    io.write_lists(cands.select("q", "candidate_ids", "row_idx"), f"{root}/candidate_pairs", "row_idx")
    kept = io.read_scores(spark, f"{root}/scores")
    matched = match_lists(kept, queries, plan.threshold, plan.cap, plan.resolve).join(queries, "q")
    io.write_lists(matched.select("q", "matched_ids", "row_idx"), f"{root}/matching_results", "row_idx")
    rethreshold(spark, f"{root}/scores", queries, VARIANTS, plan.cap).write.mode("overwrite").partitionBy("thr").parquet(f"{root}/variants")
    decided = decide.decide(kept, plan.threshold, plan.cap, plan.resolve)
    flat = queries.select("q").join(decided.select("q", "c"), "q", "left")
    facts = {"settings": asdict(plan), "candidates": scored.count(), "links": decided.count(), "violations": io.validated(flat, scored.select(F.col("q").cast("string"), F.col("c").cast("string")), queries)}
    io.write_run(spark, f"{root}/run.json", facts)
    return facts


def rethreshold(spark: SparkSession, score_path: str, queries: DataFrame, thresholds: list[float], cap: int = 15) -> DataFrame:
    """Match lists at other thresholds from stored scores, without scoring again."""
    return variants(io.read_scores(spark, score_path), queries, thresholds, cap)
