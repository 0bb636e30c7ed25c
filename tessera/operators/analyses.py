"""Analyses of records, truth, blocking keys and predictions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocking import Blocking, candidates, frequencies, index, postings, scores


def integrity(records: DataFrame, listed: DataFrame, truth: DataFrame) -> DataFrame:
    """(check, n): ids that occur twice, queries that the truth does not list, listed ones that are no queries, matched ids
    that no record has, pool records of several queries."""
    asked, pool = records.where("is_query").select(F.col("id").alias("q")), records.where("not is_query").select(F.col("id").alias("c"))
    parts = {
        "repeated_ids": records.groupBy("id").count().where("count > 1"),
        "unlisted_queries": asked.join(listed, "q", "left_anti"),
        "unknown_queries": listed.select("q").distinct().join(asked, "q", "left_anti"),
        "unknown_matches": truth.select("c").distinct().join(pool, "c", "left_anti"),
        "shared_matches": truth.distinct().groupBy("c").count().where("count > 1"),
    }
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def orphan_share(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, n, orphans, share) of the pool's sources: records that match nothing."""
    used = truth.select(F.col("c").alias("id"), F.lit(1).alias("used")).distinct()
    alone = F.sum(F.when(F.col("used").isNull(), 1).otherwise(0))
    per = records.where("not is_query").join(used, "id", "left").groupBy("src").agg(F.count("*").alias("n"), alone.alias("orphans"))
    return per.select("src", "n", "orphans", F.round(F.col("orphans") / F.col("n"), 6).alias("share"))


def missingness(records: DataFrame) -> DataFrame:
    """(src, country, n, no_name, no_address, mix): shares of empty fields, and the country's share of the source."""
    empty = lambda c: F.round(F.avg((F.trim(F.coalesce(c, F.lit(""))) == "").cast("int")), 6)
    per = records.groupBy("src", "country").agg(F.count("*").alias("n"), empty("name").alias("no_name"), empty("address").alias("no_address"))
    total = per.groupBy("src").agg(F.sum("n").alias("t"))
    return per.join(total, "src").select("src", "country", "n", "no_name", "no_address", F.round(F.col("n") / F.col("t"), 6).alias("mix"))


def country_table(records: DataFrame) -> DataFrame:
    """(country, queries, pool, both): records of each side by label; ``both`` marks labels that both sides have."""
    side = lambda q: F.sum((F.col("is_query") == F.lit(q)).cast("long"))
    per = records.groupBy("country").agg(side(True).alias("queries"), side(False).alias("pool"))
    return per.withColumn("both", ((F.col("queries") > 0) & (F.col("pool") > 0)).cast("int"))


def within_country(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(pairs, same): truth pairs, and the share whose two records have one country."""
    at = records.select("id", "country")
    both = truth.join(at.toDF("q", "a"), "q").join(at.toDF("c", "b"), "c")
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("same"))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams of a text without its blanks; a shorter text is one gram, an empty one none."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    at = F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.substr(bare, i, F.lit(n)))))


def word_grams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams within words bounded by blanks, as a text of tokens: a channel for ``postings``."""
    padded = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    of = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))))
    return F.array_join(F.array_distinct(F.concat(*[of(n) for n in sizes])), " ")


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def key_recall(seen: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: truth pairs, and how many of them each blocking key would meet."""
    v = seen.select("id", "name_core", "addr_plain", "addr_postal")
    both = truth.join(v.toDF("q", "n1", "a1", "p1"), "q").join(v.toDF("c", "n2", "a2", "p2"), "c")
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    head = lambda n: count((F.col("n1") != "") & (F.substring("n1", 1, n) == F.substring("n2", 1, n)))
    first = lambda c: F.substring_index(c, " ", 1)
    meet = lambda a, b: F.arrays_overlap(a, b)
    return both.agg(
        F.count("*").alias("pairs"), count(meet(words(F.col("n1")), words(F.col("n2")))).alias("name_token"), count((F.col("n1") != "") & (first("n1") == first("n2"))).alias("first_token"), head(4).alias("prefix4"), head(6).alias("prefix6"),
        count(meet(grams(F.col("n1"), 3), grams(F.col("n2"), 3))).alias("trigram"), count(meet(words(F.col("a1")), words(F.col("a2")))).alias("addr_token"), count((F.col("p1") != "") & (F.col("p1") == F.col("p2"))).alias("postal"))


def separability(seen: DataFrame, labelled: DataFrame) -> DataFrame:
    """(y, n, tokens, trigrams, exact): mean similarities of names by label of pairs (q, c, y)."""
    v = seen.select("id", "name_core")
    both = labelled.select("q", "c", "y").join(v.toDF("q", "a"), "q").join(v.toDF("c", "b"), "c")
    a, b = F.col("a"), F.col("b")
    mean = lambda x: F.round(F.avg(x), 6)
    return both.groupBy("y").agg(F.count("*").alias("n"), mean(jaccard(words(a), words(b))).alias("tokens"), mean(jaccard(grams(a, 3), grams(b, 3))).alias("trigrams"), mean(((a == b) & (a != "")).cast("int")).alias("exact"))


def union_blocker(records: DataFrame, channels: dict[str, str], truth: DataFrame, max_df: int) -> DataFrame:
    """(n_q, pairs, median, p95, most, recall) of a blocker that takes every pool record sharing a token of at most ``max_df``."""
    posts = postings(records, channels).where("channel <> ''")
    some = frequencies(posts).where(F.col("df") <= max_df).select("country", "channel", "tok")
    posts = posts.join(some, ["country", "channel", "tok"])
    pool, asked = posts.where("not is_query"), posts.where("is_query")
    met = asked.select("country", "channel", "tok", F.col("id").alias("q")).join(pool.select("country", "channel", "tok", F.col("id").alias("c")), ["country", "channel", "tok"]).select("q", "c").distinct()
    marked = met.join(truth.select("q", "c", F.lit(1).alias("hit")).distinct(), ["q", "c"], "left")
    per = records.where("is_query").select(F.col("id").alias("q")).join(marked.groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("hit")), "q", "left").na.fill(0)
    total = truth.distinct().agg(F.count("*").alias("t"))
    out = per.agg(F.count("*").alias("n_q"), F.sum("n").alias("pairs"), F.expr("percentile(n, 0.5)").alias("median"), F.expr("percentile(n, 0.95)").alias("p95"), F.max("n").alias("most"), F.sum("hit").alias("hit"))
    return out.crossJoin(total).select("n_q", "pairs", "median", "p95", "most", F.round(F.col("hit") / F.greatest("t", F.lit(1)), 6).alias("recall"))  # one row each


def ranking_variants(records: DataFrame, channels: dict[str, str], truth: DataFrame, p: Blocking, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(variant, recall_k, ...): recall at k of truth pairs by blended rank, with weights scaled in different ways."""
    out, all_ = None, truth.select("q", "c").distinct()
    for norm in ("candidate", "full", "none"):
        q = replace(p, norm=norm, k_main=max(ks), k_name=0)
        found = candidates(scores(index(records, channels, q), q), q).select("q", "c", "rank")
        row = all_.join(found, ["q", "c"], "left").agg(*[F.round(F.sum((F.coalesce("rank", F.lit(10**6)) < k).cast("int")) / F.greatest(F.count("*"), F.lit(1)), 6).alias(f"recall_{k}") for k in ks])
        row = row.select(F.lit(norm).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def prediction_profile(scored: DataFrame, decided: DataFrame) -> DataFrame:
    """(country, n, mean_pred, empty, six_or_more, s3_share, histogram) of decided pairs over all entities (q, country, npred)."""
    s3 = decided.select("q", "c").join(scored.select("q", "country"), "q").groupBy("country").agg(F.round(F.avg(F.col("c").cast("string").startswith("S3-").cast("int")), 6).alias("s3_share"))
    n = F.col("npred")
    share = lambda test: F.round(F.avg(test.cast("int")), 6)
    bars = F.concat_ws(",", *[F.sum((F.least(n, F.lit(6)) == k).cast("long")).cast("string") for k in range(7)])
    per = scored.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_pred"), share(n == 0).alias("empty"), share(n >= 6).alias("six_or_more"), bars.alias("histogram"))
    return per.join(s3, "country", "left").select("country", "n", "mean_pred", "empty", "six_or_more", F.coalesce("s3_share", F.lit(0.0)).alias("s3_share"), "histogram")


def threshold_profile(lists: DataFrame) -> DataFrame:
    """(thr, links, per_query, empty) of match lists (thr, q, matched_ids)."""
    n = F.when(F.col("matched_ids") == "", 0).otherwise(F.size(F.split("matched_ids", ",")))
    return lists.groupBy("thr").agg(F.sum(n).cast("long").alias("links"), F.round(F.avg(n), 6).alias("per_query"), F.round(F.avg((n == 0).cast("int")), 6).alias("empty"))
