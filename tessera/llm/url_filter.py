"""URL filters: host-suffix and path-prefix expressions against a rule list, by hash prefix and full digest.

Built-in functions only. Each distinct (host, path) is expanded into its host suffixes; those that some rule names are
expanded further by path prefixes of the lengths that the rules of that host have. Both expansions meet the rules in an
equi-join on the first bytes of their SHA-256; the full digests confirm. The longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule lists of up to so many rules and characters are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST_RULES = 100_000
MAX_BROADCAST_CHARS = 8_000_000
#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``.

    A null url and one without ``://`` have neither: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs such as ``("example.com/en/7", "allow")`` as a DataFrame."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules]
    if not rows:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _digested(df: DataFrame, text: Column) -> DataFrame:
    df = df.withColumn("__digest", F.sha2(text, 256))
    return df.withColumn("__short", F.substring("__digest", 1, PREFIX_DIGITS))


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` for each row.

    A rule ``host/path`` fits its host and every subdomain if the url's path starts with the rule's path. The longest rule
    wins; between rules of equal length the longer host, then ``block``, then the greater rule string. No rule: ``rule``
    is null and ``verdict`` is ``default``. Null or relative urls have an empty host and fit no rule; null and empty rules
    fit nothing. Repeated rows are judged alike and all kept; repeated rules count once; columns of ``pages`` named as a
    result column are replaced; an empty table stays empty. Rules may be of any number and length, urls of any length: a
    url yields at most one expression for each of its host suffixes and each path length among that host's rules.
    """
    at = F.instr("rule", "/")
    parsed = rules.where(F.col("rule").isNotNull() & (F.col("rule") != "")).select(
        "rule", "verdict",
        F.translate(F.when(at > 0, F.substr("rule", F.lit(1), at - 1)).otherwise(F.col("rule")), _UPPER, _LOWER).alias("__host"),
        F.when(at > 0, F.substr("rule", at)).otherwise("").alias("__path"),
    ).where(F.col("__host") != "").distinct()
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    judged = pages.select(*[f"`{c}`" for c in kept], host.alias("host"), path.alias("path"))

    n, chars = parsed.agg(F.count("*"), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if n <= MAX_BROADCAST_RULES and chars <= MAX_BROADCAST_CHARS else lambda df: df  # both sides follow the rules' size
    hosts = parsed.groupBy("__host").agg(F.collect_set(F.length("__path")).alias("__lens"))  # at most one length a character of the longest rule
    hosts = _digested(hosts, F.col("__host")).select("__lens", "__digest", "__short")
    side = _digested(parsed, F.concat("__host", "__path")).select("rule", "verdict", F.length("__host").alias("__hlen"), "__digest", "__short")
    urls = judged.where(F.col("host") != "").select("host", "path").distinct()
    suffixes = urls.select("host", "path", F.explode(F.expr("sequence(1, length(host) - length(translate(host, '.', '')) + 1)")).alias("labels"))
    suffixes = suffixes.select("host", "path", F.expr("substring_index(host, '.', -labels)").alias("__suffix"))
    named = _digested(suffixes, F.col("__suffix")).withColumnRenamed("__digest", "__seen").join(small(hosts), "__short").where(F.col("__seen") == F.col("__digest"))
    seen = named.select("host", "path", "__suffix", F.explode(F.filter("__lens", lambda x: x <= F.length("path"))).alias("plen"))
    seen = _digested(seen, F.expr("concat(__suffix, left(path, plen))")).select("host", "path", F.col("__digest").alias("__seen"), "__short")
    found = seen.join(small(side), "__short").where(F.col("__seen") == F.col("__digest"))
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "__hlen", (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("m"))
    out = judged.join(best.withColumnsRenamed({"host": "__h", "path": "__p"}), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return out.select(*[f"`{c}`" for c in kept], "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
