"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_wrapper, licenses, mixing, near_duplicates, ordinal, pii, quality_rules, suffix_dedup, url_filter
from tessera.llm.text import written

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: The key of surrogates; a deployment passes its own secret to the operator.
PII_KEY = "surrogate-key-of-the-registered-query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done, _ = written(pii.pseudonymise(docs, PII_KEY), "surrogates")  # the checks read its spans, then the result its texts
    return pii.checked(done).select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).alias("n_entities"), "pii", "pii_checks")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return suffix_dedup.kept(*found).drop("kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "n_bad_words")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    scored = ordinal.select(ordinal.score(docs, model), above=1)
    return scored.select("doc_id", "expected_grade", F.element_at("tail", 1).alias("p_above_0"), F.element_at("tail", 2).alias("p_above_1"), "kept")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_wrapper.main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_pii_surrogates, op3_suffix_dedup, op4_license_scan, op5_quality_rules, op6_ordinal_quality, op7_source_mix, op8_html_main_text, op9_decontamination, op10_near_duplicates)
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_SQL_RULES = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in RULES)

_OP1 = rf"""
with rules(rule, verdict, rhost, rpath) as (values {_SQL_RULES}),
cut as (select page_id, url, instr(url, '://') as k from pages),
rest as (select page_id, case when k > 0 then substring(url, k + 3) else '' end as r from cut),
p as (select page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from rest),
fit as (select p.n, r.rule, r.verdict, row_number() over (partition by p.n order by length(r.rule) desc, length(r.rhost) desc, r.rule desc) as k
        from p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from p left join fit f on p.n = f.n and f.k = 1
"""

_OP5 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, {_WORDS.format('t')} as words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
tri as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
many as (select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from tri),
cover as (select r, count(distinct i + k) as n from many, (values (0), (1), (2)) s(k) where n >= 2 group by r),
l as (select r, unnest(lines) as line from w),
lw as (select r, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line, {_WORDS.format('line')} as words from l),
bad as (select r, len(words) as n,
          len(list_filter(words, lambda x: x in ('|', '»', '›', '•', '·', '>', '/'))) > 0.2 * len(words)
          or len(regexp_extract_all(line, '[#*$%&]{{2,}}')) > 0.2 * len(words)
          or len(list_filter(words, lambda x: ends_with(x, '!'))) > 0.3 * len(words)
          or (len(words) >= 60 and not regexp_matches(line, '[.!?…:;,"''”’»)\]]$'))
          or (len(words) between 4 and 12 and regexp_matches(line, '{quality_rules.LineRules().menu}'))
          or (len(words) <= 30 and regexp_matches(line, '{quality_rules.LineRules().boilerplate}')) as b from lw),
s as (select r, count(*) as lines, sum(n) as bw from bad where b group by r),
o as (select w.r, doc_id, len(w.words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(w.lines) - len(list_distinct(w.lines)))::bigint as n_dup_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(s.lines, 0)::bigint as n_bad_lines, coalesce(s.bw, 0)::bigint as n_bad_words
      from w left join cover c on c.r = w.r left join s on s.r = w.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_bad_words <= 0.5 * n_words as kept, n_bad_lines, n_bad_words from o
"""

_OP7 = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
u as (select *, row_number() over (partition by doc_id, source, size) as copy from d),
s0 as (select source, sum(size)::bigint as ssize from d group by source),
s as (select *, row_number() over (order by source is null, source) - 1 as pos, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w from s0),
t as (select sum(ssize)::bigint as total, sum(w) as weight from s),
f as (select s.*, row_number() over o as k, (total - coalesce(sum(3 * ssize) over (o rows between unbounded preceding and 1 preceding), 0))::double
        / (weight - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::double as level
      from s, t window o as (order by 3.0 * ssize / w, pos)),
k0 as (select min(k) as k0, arg_min(level, k) as level0 from f where 3 * ssize >= level * w),
g as (select f.source, pos, ssize, w, case when k < k0 then (3 * ssize)::double else level0 * w end as target from f, k0),
e as (select *, floor(sum(target) over (order by pos) / (select sum(target) from g) * 4294967296.0)::bigint as hi0, row_number() over (order by pos desc) as back from g),
e2 as (select *, case when back = 1 then 4294967296 else hi0 end as hi from e),
e3 as (select *, coalesce(lag(hi) over (order by pos), 0) as lo from e2),
n as (select unnest(range(0, (select (total + 255) // 256 from t))) as slot),
p as (select slot, ((slot::hugeint * 11400714819323198485) % 18446744073709551616) // 4294967296 as point from n),
c as (select pos, count(*) as slots, max(slot) as last from p join e3 on point >= lo and point < hi group by pos),
b as (select e3.source, e3.ssize, e3.target, least(coalesce(slots, 0) * 256 - case when last = (select max(slot) from n) then 256 * (last + 1) - (select total from t) else 0 end, 3 * e3.ssize) as upto
      from e3 left join c on c.pos = e3.pos),
x as (select u.*, b.ssize, b.target, b.upto, ep, md5(concat_ws('|', 'mix', ep, doc_id, copy)) as h
      from u join b on u.source is not distinct from b.source, (values (0), (1), (2)) z(ep)),
y as (select *, ep * ssize + sum(size) over (partition by source, ep order by h, doc_id, size, copy rows unbounded preceding) - size as a from x)
select doc_id, size, ssize as source_size, any_value(target) as target, sum(greatest(0, least(a + size, upto) - a))::bigint as taken
from y group by doc_id, size, ssize, source, copy
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _OP1, "op5_quality_rules": _OP5, "op7_source_mix": _OP7}
