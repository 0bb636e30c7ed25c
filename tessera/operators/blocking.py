"""Blocking: an inverted-index TF-IDF join with top-k for each query, on two channels.

The index is one table of weighted postings, written once: text is read and split once whatever is asked of it after that.
Everything is keyed by (country, token), so no country needs a task of its own. Frequent tokens over the document-frequency
cap are dropped before records are shuffled by token; a cap fraction f leaves at most (tokens a record) / f of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.sources.tables import table


#: Tokens of at least this many pool records are dropped before the shuffle by token, if the cap drops them and they are few.
HEAVY = 1_000
MOST_HEAVY = 500_000


@dataclass(frozen=True)
class Blocking:
    df_frac: float = 0.005
    min_cap: int = 5
    #: No token of more pool records than this is used, however large the pool; None leaves it to the fraction.
    max_df: int | None = None
    weight: float = 0.5
    k_main: int = 50
    k_name: int = 10
    #: Pool records of one token that one task meets a query with; a token of more is salted.
    salt: int = 10_000
    #: How a pool record's dot product is scaled: "candidate" by its norm, "none" not at all, "full" by both norms.
    norm: str = "candidate"


def postings(records: DataFrame, channels: dict[str, str]) -> DataFrame:
    """(country, id, is_query, channel, tok): distinct tokens of two characters or more of each channel's column.

    Each record also has a row of channel and token '', so that sizes count records without any token.
    """
    each = [F.struct(F.lit(c).alias("channel"), F.filter(F.split(F.col(v), " "), lambda t: F.length(t) >= 2).alias("toks")) for c, v in channels.items()]
    mark = F.struct(F.lit("").alias("channel"), F.array(F.lit("")).alias("toks"))
    df = records.select("country", "id", "is_query", F.explode(F.array(mark, *each)).alias("v"))
    return df.select("country", "id", "is_query", F.col("v.channel").alias("channel"), F.explode(F.array_distinct("v.toks")).alias("tok"))


def frequencies(posts: DataFrame) -> DataFrame:
    """Document frequencies over the pool only."""
    return posts.where("not is_query and channel <> ''").groupBy("country", "channel", "tok").agg(F.count("*").alias("df"))


def _cap(p: Blocking, frac: float, n: Column) -> Column:
    cap = F.greatest(F.lit(p.min_cap), F.floor(F.lit(frac) * n))
    return cap if p.max_df is None else F.least(cap, F.lit(p.max_df))


def idf(posts: DataFrame, p: Blocking, fracs: tuple[float, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """(country, channel, tok, df, idf, kept): ``kept`` says for each cap whether the token is under it, or among the rarest
    tenth where no token is. Tokens that no cap keeps are left out. ``counts``: the frequencies, if they are written already."""
    fracs = fracs or (p.df_frac,)
    size = posts.where("channel = '' and not is_query").groupBy("country").agg(F.count("*").alias("n"))
    df = (frequencies(posts) if counts is None else counts).join(size, "country")
    under = F.array(*[F.col("df") <= _cap(p, f, F.col("n")) for f in fracs])
    df = df.withColumn("under", under)
    vocab = df.groupBy("country", "channel").agg(F.count("*").alias("vocab"), F.array(*[F.max(F.col("under")[k]) for k in range(len(fracs))]).alias("some"))
    df = df.join(vocab, ["country", "channel"])
    kept = df.where(F.exists("under", lambda u: u)).select("country", "channel", "tok", "df", "n", F.col("under").alias("kept"))
    bare = df.where(F.exists("some", lambda s: ~s))
    rarest = bare.withColumn("r", F.row_number().over(W.partitionBy("country", "channel").orderBy("df", "tok"))).where("r <= greatest(1, vocab div 10)")
    rarest = rarest.select("country", "channel", "tok", "df", "n", F.transform("some", lambda s: ~s).alias("rare"))
    both = kept.join(rarest.select("country", "channel", "tok", F.col("rare"), F.col("df").alias("df2"), F.col("n").alias("n2")), ["country", "channel", "tok"], "full")
    none = F.array(*[F.lit(False)] * len(fracs))
    flags = F.zip_with(F.coalesce("kept", none), F.coalesce("rare", none), lambda a, b: a | b)
    return both.select("country", "channel", "tok", F.coalesce("df", "df2").alias("df"), F.log(F.coalesce("n", "n2") / F.coalesce("df", "df2")).alias("idf"), flags.alias("kept"))


def index(records: DataFrame, channels: dict[str, str], p: Blocking, fracs: tuple[float, ...] = ()) -> DataFrame:
    """(country, channel, tok, id, is_query, df, idf, w) of the kept tokens, as a written table.

    ``w`` has a weight for each cap: idf over the norm of the pool record's kept tokens; null where the cap drops the token.
    A query's weight is its plain idf.
    """
    fracs = fracs or (p.df_frac,)
    posts = table(postings(records, channels), "postings")
    weights = table(idf(posts, p, fracs), "weights")
    heavy = frequencies(posts).where(F.col("df") >= HEAVY).join(weights, ["country", "channel", "tok"], "left_anti").select("country", "channel", "tok")
    heavy = table(heavy, "heavy")
    light = posts.where("channel <> ''")
    if 0 < heavy.count() <= MOST_HEAVY:  # else the join below drops them
        light = light.join(F.broadcast(heavy), ["country", "channel", "tok"], "left_anti")
    df = light.join(weights, ["country", "channel", "tok"])
    square = lambda k: F.when(F.col("kept")[k], F.col("idf") * F.col("idf"))
    of = W.partitionBy("country", "channel", "id", "is_query")
    scaled = {"candidate": ~F.col("is_query"), "full": F.lit(True), "none": F.lit(False)}[p.norm]
    for k in range(len(fracs)):
        df = df.withColumn(f"n{k}", F.sqrt(F.sum(square(k)).over(of)))
    w = [F.when(F.col("kept")[k] & (F.col(f"n{k}") > 0), F.col("idf") / F.when(scaled, F.col(f"n{k}")).otherwise(1.0)) for k in range(len(fracs))]
    return table(df.select("country", "channel", "tok", "id", "is_query", "df", "idf", F.array(*w).alias("w")), "index")


def hits(indexed: DataFrame, p: Blocking) -> DataFrame:
    """(country, channel, q, c, x): products of weights for each token and cap; tokens of many pool records are salted."""
    parts = F.ceil(F.col("df") / p.salt)
    pool = indexed.where("not is_query").select("country", "channel", "tok", F.col("id").alias("c"), F.col("w").alias("cw"), F.pmod(F.xxhash64("id"), parts).alias("salt"))
    query = indexed.where("is_query").select("country", "channel", "tok", F.col("id").alias("q"), F.col("w").alias("qw"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    both = query.join(pool, ["country", "channel", "tok", "salt"])
    return both.select("country", "channel", "q", "c", F.zip_with("qw", "cw", lambda a, b: a * b).alias("x"))


def scores(indexed: DataFrame, p: Blocking) -> DataFrame:
    """(country, q, c, ncos, acos) at the first cap: dot products by channel."""
    x = F.col("x")[0]
    sums = hits(indexed, p).where(x.isNotNull()).groupBy("country", "q", "c")
    sums = sums.agg(F.sum(F.when(F.col("channel") == "name", x)).alias("n"), F.sum(F.when(F.col("channel") != "name", x)).alias("a"))
    return sums.select("country", "q", "c", F.coalesce("n", F.lit(0.0)).alias("ncos"), F.coalesce("a", F.lit(0.0)).alias("acos"))


def top(scored: DataFrame, by: str, k: int, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """The best k rows of each query by a score, ties by id; ``rank`` counts from 0."""
    ranked = scored.where(F.col(by) > 0).withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.round(by, 6).desc(), "c")))
    return ranked.where(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")


def top_names(scored: DataFrame, k: int) -> DataFrame:
    """Best k pool records of each query by name."""
    return top(scored, "ncos", k).select("country", "q", "c", F.round("ncos", 6).alias("ncos"), "rank")


def candidates(scored: DataFrame, p: Blocking, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """(country, q, c, blk, ncos, acos, rank, in_name): blended top k united with name-only top k."""
    df = scored.withColumn("blk", F.lit(p.weight) * F.col("ncos") + F.lit(1 - p.weight) * F.col("acos"))
    main = top(df, "blk", p.k_main, keys).withColumn("in_name", F.lit(0))
    name = top(df, "ncos", p.k_name, keys).withColumn("rank", F.lit(None).cast("int")).withColumn("in_name", F.lit(1))
    rest = [c for c in main.columns if c not in ("blk", "ncos", "acos", "rank", "in_name")]
    both = main.unionByName(name).groupBy(*rest).agg(F.first("blk").alias("blk"), F.first("ncos").alias("ncos"), F.first("acos").alias("acos"), F.min("rank").alias("rank"), F.max("in_name").alias("in_name"))
    return both.withColumn("rank", F.coalesce("rank", F.lit(p.k_main)))


def sweep(records: DataFrame, channels: dict[str, str], truth: DataFrame, p: Blocking, fracs: list[float], slack: float = 0.005) -> DataFrame:
    """(df_frac, pairs, per_query, recall, chosen) of candidate sets at several caps, from one index and one join.

    ``chosen`` marks the smallest cap whose recall is within ``slack`` of the best.
    """
    x = lambda k, name: F.sum(F.when((F.col("channel") == "name") == F.lit(name), F.col("x")[k]))
    sums = hits(index(records, channels, p, tuple(fracs)), p).groupBy("country", "q", "c").agg(*[x(k, True).alias(f"n{k}") for k in range(len(fracs))], *[x(k, False).alias(f"a{k}") for k in range(len(fracs))])
    each = F.array(*[F.struct(F.lit(f).alias("df_frac"), F.coalesce(f"n{k}", F.lit(0.0)).alias("ncos"), F.coalesce(f"a{k}", F.lit(0.0)).alias("acos")) for k, f in enumerate(fracs)])
    scored = sums.select("country", "q", "c", F.inline(each)).where("ncos + acos > 0")
    found = candidates(scored, p, ("df_frac", "q")).select("df_frac", "q", "c")
    marked = found.join(truth.select("q", "c", F.lit(1).alias("hit")).distinct(), ["q", "c"], "left")
    per = marked.groupBy("df_frac").agg(F.count("*").alias("pairs"), F.countDistinct("q").alias("n_q"), F.count("hit").alias("hit"))
    all_ = F.broadcast(truth.select("q", "c").distinct().agg(F.count("*").alias("n")))  # one row
    out = per.join(all_).select("df_frac", "pairs", F.round(F.col("pairs") / F.greatest("n_q", F.lit(1)), 6).alias("per_query"), F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6).alias("recall"))
    good = F.col("recall") >= F.max("recall").over(W.partitionBy()) - slack  # a row a cap
    out = out.withColumn("good", good)
    return out.withColumn("chosen", (F.col("df_frac") == F.min(F.when(F.col("good"), F.col("df_frac"))).over(W.partitionBy())).cast("int")).drop("good")


def stats(indexed: DataFrame, posts: DataFrame) -> DataFrame:
    """(country, channel, pool, vocab, nnz): pool records, kept tokens and weights of the index."""
    size = posts.where("channel = '' and not is_query").groupBy("country").agg(F.count("*").alias("pool"))
    held = indexed.where("not is_query and w[0] is not null").groupBy("country", "channel").agg(F.countDistinct("tok").alias("vocab"), F.count("*").alias("nnz"))
    return held.join(size, "country").select("country", "channel", "pool", "vocab", "nnz")
