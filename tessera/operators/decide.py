"""Decisions over scored pairs, their metrics, and sinks' list forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def decide(pairs: DataFrame, threshold: float, cap: int = 15, resolve: bool = True, q_order: str = "q", c_order: str = "c") -> DataFrame:
    """Pairs (q, c, p) with p >= threshold, each c with its best q, then each q's best ``cap``.

    Ties go to the smaller ``q_order`` for a c, and to the smaller ``c_order`` for a q: name columns of input positions there
    to keep the order of the input. A pair that the cap drops is not given elsewhere.
    """
    return _ranked(pairs, threshold, resolve, q_order, c_order).where(F.col("r") <= cap).drop("r")


def _ranked(pairs: DataFrame, threshold: float, resolve: bool, q_order: str, c_order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of a decision without a cap, and ``r``, their rank within q from 1 on; each group of ``within`` by itself."""
    kept = pairs.where(F.col("p") >= threshold)
    if resolve:
        kept = kept.withColumn("r", F.row_number().over(W.partitionBy(*within, "c").orderBy(F.desc("p"), q_order))).where("r <= 1").drop("r")
    return kept.withColumn("r", F.row_number().over(W.partitionBy(*within, "q").orderBy(F.desc("p"), c_order)))


def trials(pairs: DataFrame, entities: DataFrame, runs: dict[str, dict], q_order: str = "q", c_order: str = "c") -> DataFrame:
    """(q, country, f05_<run>, ...): each entity's F0.5 under several ``runs``, arguments of ``decide``.

    As in ``threshold_grid``, pairs are ranked once for all runs that resolve and once for the others, at the lowest threshold.
    """
    runs = {name: {"threshold": 0.75, "cap": 15, "resolve": True} | how for name, how in runs.items()}
    out = entities
    for resolve in (True, False):
        mine = {name: how for name, how in runs.items() if how["resolve"] is resolve}
        if mine:
            kept = {name: (F.col("p") >= how["threshold"]) & (F.col("r") <= how["cap"]) for name, how in mine.items()}
            sums = [F.sum(F.when(on, x).otherwise(0)).alias(f"{at}_{name}") for name, on in kept.items() for at, x in (("tp", F.col("y")), ("npred", F.lit(1)))]
            ranked = _ranked(pairs.select(*dict.fromkeys(("q", "c", "p", "y", q_order, c_order))), min(how["threshold"] for how in mine.values()), resolve, q_order, c_order)
            out = out.join(ranked.groupBy("q").agg(*sums), "q", "left")
    tally = lambda at, name: F.coalesce(f"{at}_{name}", F.lit(0))
    return out.select("q", "country", *[f05(tally("tp", name), tally("npred", name), F.col("tsize")).alias(f"f05_{name}") for name in runs])


def f05(tp: Column, n_pred: Column, size: Column) -> Column:
    """F0.5 of one entity; a singleton scores 1 without and 0 with predictions."""
    precision, recall = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(size, F.lit(1))
    full = F.lit(1.25) * precision * recall / (F.lit(0.25) * precision + recall)
    return F.when(size == 0, (n_pred == 0).cast("double")).when(tp == 0, 0.0).otherwise(full)


def entity_scores(decided: DataFrame, entities: DataFrame) -> DataFrame:
    """Each entity (q, country, tsize) with tp, npred and f05; entities without predictions count."""
    made = decided.groupBy("q").agg(F.sum("y").alias("tp"), F.count("*").alias("npred"))
    out = entities.join(made, "q", "left").na.fill(0, ["tp", "npred"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("npred"), F.col("tsize")))


def report(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro means of entity scores."""
    solid, single = F.col("tsize") > 0, F.col("tsize") == 0
    precision = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    aggs = [F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("f05"), F.round(F.avg(F.when(solid, precision)), 6).alias("mean_p"),
            F.round(F.avg(F.when(solid, F.col("tp") / F.greatest("tsize", F.lit(1)))), 6).alias("mean_r"),
            F.round(F.avg(F.when(single, (F.col("npred") == 0).cast("double"))), 6).alias("singleton_acc"), F.round(F.avg("npred"), 6).alias("pred_per_q")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def threshold_grid(pairs: DataFrame, entities: DataFrame, grid: list[float], cap: int = 15, weights: DataFrame | None = None) -> DataFrame:
    """(thr, f05, ..., f05_testmix) for every threshold, from one decision.

    The best q of a c does not depend on the threshold, and what a threshold keeps of a q's ranked pairs is a prefix: so
    pairs are resolved and ranked once, at the lowest threshold, and counted for all. Without ``weights`` (country, w), or
    where no country has one, ``f05_testmix`` is the plain mean.
    """
    full = _tried(decide(pairs, min(grid), cap), entities, grid)
    out = report(full, ("thr",))
    return out.join(test_mix(full, weights, ("thr",)), "thr")


def _tried(decided: DataFrame, entities: DataFrame, grid: list[float], by: tuple[str, ...] = ("q",)) -> DataFrame:
    """(q, country, tsize, thr, tp, npred, f05) of every threshold and entity, from what the lowest threshold decided."""
    steps = F.array(*[F.lit(float(t)) for t in grid])
    counted = [F.array(*[F.sum(F.when(F.col("p") >= float(t), x)) for t in grid]).alias(name) for name, x in (("tps", F.col("y")), ("npreds", F.lit(1)))]
    made = decided.groupBy(*by).agg(*counted)
    each = F.arrays_zip(steps.alias("thr"), F.coalesce("tps", F.array_repeat(F.lit(0).cast("long"), len(grid))).alias("tp"), F.coalesce("npreds", F.array_repeat(F.lit(0).cast("long"), len(grid))).alias("npred"))
    full = entities.join(made, list(by), "left").select("q", "country", "tsize", F.inline(each).alias("thr", "tp", "npred")).na.fill(0, ["tp", "npred"])
    return full.withColumn("f05", f05(F.col("tp"), F.col("npred"), F.col("tsize")))


def country_grid(pairs: DataFrame, entities: DataFrame, grid: list[float], cap: int = 15) -> DataFrame:
    """(country, thr, n, total): a country's entities and the sum of their F0.5 for every threshold, from one decision.

    Each country's pairs are decided by themselves.
    """
    ranked = _ranked(pairs.select("country", "q", "c", "p", "y"), min(grid), True, "q", "c", ("country",))
    full = _tried(ranked.where(F.col("r") <= cap), entities, grid, ("country", "q"))
    return full.groupBy("country", "thr").agg(F.count("*").alias("n"), F.sum("f05").alias("total"))


def test_mix(scored: DataFrame, weights: DataFrame | None, by: tuple[str, ...] = ()) -> DataFrame:
    """(f05_testmix): the mean of the countries' mean F0.5 by their ``weights`` (country, w); the plain mean without any."""
    per = scored.groupBy(*by, "country").agg(F.sum("f05").alias("s"), F.count("*").alias("n"))
    per = per.join(weights, "country", "left") if weights is not None else per.withColumn("w", F.lit(None).cast("double"))
    mean = F.coalesce(F.sum(F.col("w") * F.col("s") / F.col("n")) / F.nullif(F.sum("w"), F.lit(0.0)), F.sum("s") / F.sum("n"))
    return per.groupBy(*by).agg(F.round(mean, 6).alias("f05_testmix")) if by else per.agg(F.round(mean, 6).alias("f05_testmix"))


def tuned(grid: DataFrame, metric: str = "f05_testmix") -> DataFrame:
    """The row of the best threshold; the lowest one on a tie."""
    return grid.orderBy(F.desc(metric), "thr").limit(1)


def weights_of(queries: DataFrame, labelled: DataFrame) -> DataFrame:
    """(country, w): shares of ``queries`` (country) among the countries that ``labelled`` has, in four digits."""
    counts = queries.join(labelled.select("country").distinct(), "country", "left_semi").groupBy("country").agg(F.count("*").alias("n"))
    return counts.select("country", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("w"))  # a row a country


def blocking_report(candidates: DataFrame, truth: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """Recall at each k by blended rank, united recall, name-only hits, share of queries found whole, ceiling F0.5."""
    hits = truth.join(candidates.select("q", "c", "rank", "in_name"), ["q", "c"], "left")
    per = hits.groupBy("q").agg(F.count("*").alias("tsize"), F.count("rank").alias("found"), F.sum(F.when(F.col("rank") >= max(ks), 1).otherwise(0)).alias("name_only"), *[F.sum((F.col("rank") < k).cast("int")).alias(f"at{k}") for k in ks])
    full = queries.select("q").join(per, "q", "left").na.fill(0)
    total = F.greatest(F.sum("tsize"), F.lit(1))
    sizes = candidates.agg(F.count("*").alias("pairs"))
    out = full.agg(*[F.round(F.sum(f"at{k}") / total, 6).alias(f"recall_{k}") for k in ks], F.round(F.sum("found") / total, 6).alias("recall_union"), F.sum("name_only").alias("name_only"),
                   F.round(F.avg((F.col("found") == F.col("tsize")).cast("double")), 6).alias("all_found"), F.round(F.avg(f05(F.col("found"), F.col("found"), F.col("tsize"))), 6).alias("ceiling_f05"), F.count("*").alias("n_q"))
    return out.crossJoin(sizes)  # one row each


def lists(pairs: DataFrame, queries: DataFrame, order: list[Column], name: str) -> DataFrame:
    """One row for each query, in any case: its c's in the given order, comma-joined, empty without any."""
    made = pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("c").cast("string").alias("c")))).alias("l"))
    out = queries.select("q").join(made, "q", "left")
    return out.select("q", F.coalesce(F.array_join(F.transform("l", lambda x: x["c"]), ","), F.lit("")).alias(name))


def paired_delta(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """(delta, se) of two scorings (q, country, f05) of the same entities, countries weighted; other entities are an error."""
    both = left.select("q", "country", F.col("f05").alias("a")).join(right.select("q", F.col("f05").alias("b")), "q", "full")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = both.withColumn("d", F.when(paired, F.col("b") - F.col("a")).otherwise(F.raise_error(F.lit("the scorings are of different entities")).cast("double")))
    per = both.groupBy("country").agg(F.count("*").alias("n"), F.avg("d").alias("m"), (F.var_pop("d") * F.count("*")).alias("ss"))
    per = per.join(weights, "country")
    total = F.sum("w")
    return per.agg(F.round(F.sum(F.col("w") * F.col("m")) / total, 6).alias("delta"), F.round(F.sqrt(F.sum(F.pow(F.col("w") / F.col("n"), 2) * F.col("ss"))) / total, 6).alias("se"))


def errors(pairs: DataFrame, decided: DataFrame, n: int = 8, seed: str = "errors") -> DataFrame:
    """(kind, q, c, p): up to ``n`` false positives (decided, y = 0) and ``n`` false negatives (candidates with y = 1 that were not)."""
    wrong = decided.where("y = 0").select(F.lit("FP").alias("kind"), "q", "c", "p")
    lost = pairs.where("y = 1").join(decided.select("q", "c"), ["q", "c"], "left_anti").select(F.lit("FN").alias("kind"), "q", "c", "p")
    key = F.md5(F.concat_ws("|", F.col("q").cast("string"), F.col("c").cast("string"), F.lit(seed)))
    pick = lambda df: df.orderBy(key, "q", "c").limit(n)
    return pick(wrong).unionByName(pick(lost))
