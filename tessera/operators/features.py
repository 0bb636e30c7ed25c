"""Pair features: equality and conflict flags, numeric and house-number features, scores, and features within a query.

Missing is null, never NaN: greatest() and max() then skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.kernels import scorer

#: (feature, scorer, view) of the string scores, in model order.
SCORED = [
    ("n_core_ratio", "ratio", "name_core"), ("n_core_tset", "tset", "name_core"), ("n_core_tsort", "tsort", "name_core"), ("n_core_partial", "partial", "name_core"), ("n_core_jw", "jw", "name_core"),
    ("n_latin_ratio", "ratio", "name_latin"), ("n_latin_tset", "tset", "name_latin"), ("n_compact_ratio", "ratio", "name_compact"), ("n_compact_partial", "partial", "name_compact"), ("n_light_ratio", "ratio", "name_light"),
    ("a_ratio", "ratio", "addr_latin"), ("a_tset", "tset", "addr_latin"), ("a_partial", "partial", "addr_latin"), ("a_plain_tset", "tset", "addr_plain"), ("num_tset", "tset", "addr_num"),
]


def equal(a: Column, b: Column) -> Column:
    """1 if both are there and equal."""
    return ((a != "") & (a == b)).cast("int")


def conflict(a: Column, b: Column) -> Column:
    """1 if both are there and differ."""
    return ((a != "") & (b != "") & (a != b)).cast("int")


def flags(q: str = "q", c: str = "c") -> dict[str, Column]:
    """Flags over joined views ``q.*`` and ``c.*``."""
    v = lambda side, name: F.col(f"{side}.{name}")
    pair = lambda name: (v(q, name), v(c, name))
    return {
        "n_core_exact": equal(*pair("name_core")), "n_first_eq": equal(*pair("name_first")), "legal_same": equal(*pair("name_legal")), "legal_conflict": conflict(*pair("name_legal")),
        "num_exact": equal(*pair("addr_num")), "q_has_num": (v(q, "addr_num") != "").cast("int"), "c_has_num": (v(c, "addr_num") != "").cast("int"),
        "postal_eq": equal(*pair("addr_postal")), "postal_conflict": conflict(*pair("addr_postal")), "unit_eq": equal(*pair("addr_unit")), "unit_conflict": conflict(*pair("addr_unit")),
        "q_ncomp": v(q, "addr_ncomp"), "c_ncomp": v(c, "addr_ncomp"), "c_addr_missing": v(c, "addr_missing"), "q_deva": v(q, "deva"), "c_deva": v(c, "deva"),
        "cross_script": (v(q, "deva") != v(c, "deva")).cast("int"), "c_fixed": v(c, "fixed"), "is_s3": F.col(f"{c}.id").cast("string").startswith("S3-").cast("int"),
        "q_ntok": v(q, "name_ntok"), "c_ntok": v(c, "name_ntok"),
        "len_ratio": F.least(F.length(v(q, "name_core")), F.length(v(c, "name_core"))) / F.greatest(F.length(v(q, "name_core")), F.length(v(c, "name_core")), F.lit(1)),
        **house(v(q, "hnum"), v(c, "hnum")),
    }


def house(a: Column, b: Column) -> dict[str, Column]:
    """House-number features of two digit strings; null unless both are there."""
    x, y, both = a.try_cast("double"), b.try_cast("double"), a.isNotNull() & b.isNotNull()
    lev = F.levenshtein(a, b)
    return {
        "hn_both": both.cast("int"), "hn_eq": F.when(both, (x == y).cast("int")), "hn_absdiff": F.when(both, F.log1p(F.abs(x - y))),
        "hn_reldiff": F.when(both, F.abs(x - y) / F.greatest(x, y, F.lit(1.0))), "hn_lev": F.when(both, lev),
        "hn_trunc": F.when(both, ((lev == F.abs(F.length(a) - F.length(b))) & (F.length(a) != F.length(b))).cast("int")),
    }


def pair_features(candidates: DataFrame, views: DataFrame, keep: tuple[str, ...] = ("country", "q", "c", "blk", "ncos", "acos", "rank", "in_name")) -> DataFrame:
    """``candidates`` with every feature. Views join after top-k only, so strings of lost pairs never move."""
    q, c = views.alias("q"), views.alias("c")
    order = [F.col(f"{s}.row_idx").alias(f"{s}_idx") for s in ("q", "c") if "row_idx" in views.columns]  # positions in the input, for ties
    df = candidates.alias("p").join(q, F.col("p.q") == F.col("q.id")).join(c, F.col("p.c") == F.col("c.id"))
    sides = [F.col(f"{s}.{view}") for _, _, view in SCORED for s in ("q", "c")]
    alias = scorer([("ab", "tset"), ("ba", "tset")])(F.col("q.name_core"), F.col("c.name_alias"), F.col("q.name_alias"), F.col("c.name_core"))
    init = lambda i, k: F.when((F.length(k) <= 5) & (F.length(i) >= 2), F.when(k == "", 0.0).otherwise(scorer([("r", "ratio")])(i, k)["r"]))
    df = df.select(*[F.col(f"p.{k}").alias(k) for k in keep], *order, *[f.alias(n) for n, f in flags().items()], scorer([(n, s) for n, s, _ in SCORED])(*sides).alias("s"), F.greatest(alias["ab"], alias["ba"]).alias("alias_best"),
                   F.greatest(init(F.col("q.name_init"), F.col("c.name_compact")), init(F.col("c.name_init"), F.col("q.name_compact"))).alias("init_match"))
    return within_query(df.select("*", "s.*").drop("s"), {"name_gap": "n_core_tset", "addr_gap": "a_tset"})


def within_query(df: DataFrame, gaps: dict[str, str] | None = None) -> DataFrame:
    """n_cand, blk_rel, blk_gap and the gaps to the query's best score."""
    w = W.partitionBy("q")
    best = F.max("blk").over(w)
    made = {"n_cand": F.count("*").over(w), "blk_rel": F.col("blk") / F.greatest(best, F.lit(1e-6)), "blk_gap": best - F.col("blk")}
    return df.withColumns(made | {n: F.max(s).over(w) - F.col(s) for n, s in (gaps or {}).items()})


def frequency_rates(records: DataFrame, keys: dict[str, str], population: DataFrame | None = None) -> DataFrame:
    """``records`` with, for each new column, how often its key occurs among 100,000 records of ``population`` (its own country,
    ``records`` themselves by default); a key that the population lacks counts once, an empty one is null.

    Keys are counted before they are shuffled, and empty ones are not counted, so no key needs a task of its own.
    """
    people, out = records if population is None else population, records
    size = people.groupBy("country").agg(F.count("*").alias("__size"))
    out = out.join(size, "country", "left")
    for name, key in keys.items():
        seen = people.where(F.col(key) != "").groupBy("country", key).agg(F.count("*").alias("__n"))
        out = out.join(seen, ["country", key], "left")
        out = out.withColumn(name, F.when(F.col(key) != "", F.coalesce("__n", F.lit(1)) * 1e5 / F.greatest(F.coalesce("__size", F.lit(1)), F.lit(1)))).drop("__n")
    return out.drop("__size")
