"""The registered queries of whole linkage runs on the labelled world, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import jaro_winkler, scorer
from tessera.functions.views import first_of, house_number
from tessera.operators import analyses, blocking, decide, features, grid, lexicon, matcher, sampling
from tessera.plans import linkage
from tessera.queries import _WEIGHTS, LATIN, MEANS, Query, chain, sweep_sql
from tessera.sources import records as io
from tessera.sources.tables import exists, freed, table
from tessera.sources.world import world, world_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAN = linkage.Linkage()
CHANNELS = {"name": "name", "addr": "addr"}
_stored: dict[tuple[str, str, str], str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f"world_{f.__name__}"] = f
        if sql:
            SQL[f"world_{f.__name__}"] = sql
        return f

    return add


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of this session that several queries read, made at first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored or not exists(spark, _stored[key]):
        made = table(make(), f"world-{name}")
        freed(spark)
        if files := made.inputFiles():
            _stored[key] = files[0].rsplit("/", 1)[0]
        return made
    return spark.read.parquet(_stored[key])


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "views", lambda: linkage.views(world(spark, sf_dir)[0], PLAN))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "truth", lambda: world(spark, sf_dir)[1])


def _brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two views that records are blocked and scored by; the others are not made for them."""
    views = lambda: linkage.views(world(spark, sf_dir)[0], PLAN)
    return _once(spark, sf_dir, "brief", lambda: views().select("country", "id", "is_query", F.col("row_idx").cast("long").alias("row_idx"), F.col("name_core").alias("name"), F.col("addr_plain").alias("addr")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "pairs", lambda: linkage.staged(_views(spark, sf_dir), PLAN, _truth(spark, sf_dir)))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.entities(_brief(spark, sf_dir), _truth(spark, sf_dir))


def score(pairs: DataFrame) -> DataFrame:
    """A fixed formula in place of a trained model, so that SQL can follow a run to its end."""
    p = 0.6 * F.coalesce("n_core_jw", F.lit(0.0)) + 0.3 * F.coalesce(F.col("hn_eq").cast("double"), F.lit(0.3)) + 0.1 * F.col("n_first_eq")
    return pairs.withColumn("p", F.round(p, 6))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's candidates as lists."""
    return grid.best(grid.pack(_base(spark, sf_dir), CHANNELS, PLAN.blocking), PLAN.blocking)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.found(_lists(spark, sf_dir), PLAN.blocking)


#: Decisions here ask for this much at least, so pairs below it are kept only if they are true, or the first of their query.
FLOOR = 0.5


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(how often each has each of 128 letters, lengths, first letters); None if any is beyond ASCII."""
    texts = texts.fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = data[ends[0] : ends[-1]]
    if len(data) and data.max() > 127:
        return None
    size, at = np.diff(ends), ends[:-1] - ends[0]
    counts = np.bincount(np.repeat(np.arange(len(texts)), size) * 128 + data, minlength=len(texts) * 128).reshape(-1, 128)
    head = np.where(size > 0, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0)
    return np.minimum(counts, 255).astype(np.uint8), size, head


def _jw_most(x: pa.Array, of: np.ndarray, y: pa.Array) -> np.ndarray:
    """What the Jaro-Winkler similarity of x[of] and y is at most, by the letters they share."""
    a, b = _letters(x), _letters(y)
    if a is None or b is None or max(a[1].max(initial=0), b[1].max(initial=0)) > 255:
        return np.ones(len(of))
    used = np.flatnonzero(a[0].any(axis=0))
    shared = np.zeros(len(of))
    for letter in used:
        shared += np.minimum(a[0][of, letter], b[0][:, letter])
    jaro = np.where(shared > 0, (shared / np.maximum(a[1][of], 1) + shared / np.maximum(b[1], 1) + 1) / 3, 0.0)
    return np.where(a[2][of] == b[2], jaro + 0.4 * (1 - jaro), jaro)


def _judge(a: pa.StructArray, of: np.ndarray, c: pa.Array, b: pa.StructArray, rank: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """What ``score`` reads of pairs, and their label; all that ``_scored`` keeps and a few at its edge.

    Names are compared where the pair may be kept by what their letters allow at most.
    """
    x, firsts, trues = (a.field(name).to_pylist() for name in ("core", "first", "true"))
    trues = [set(t or ()) for t in trues]
    first = np.array([(firsts[i] != "") & (firsts[i] == t) for i, t in zip(of, b.field("first").to_pylist(), strict=True)], bool)
    h, g = (z.field("num").to_numpy(zero_copy_only=False).astype(float) for z in (a, b))
    h = h[of]
    none = np.isnan(h) | np.isnan(g)
    true = np.array([t in trues[i] for i, t in zip(of, c.to_pylist(), strict=True)], bool)
    rest = 0.3 * np.where(none, 0.3, h == g) + 0.1 * first
    maybe = np.flatnonzero((0.6 * _jw_most(a.field("core"), of, b.field("core")) + rest >= FLOOR - 1e-5) | true | (rank == 0))
    jw = np.full(len(of), np.nan)
    jw[maybe] = [jaro_winkler(s, t) if s and t else np.nan for s, t in zip([x[i] for i in of[maybe]], b.field("core").take(pa.array(maybe)).to_pylist(), strict=True)]
    p = 0.6 * np.nan_to_num(jw) + rest
    on = np.intersect1d(maybe, np.flatnonzero((p >= FLOOR - 1e-5) | true | (rank == 0)))
    at = pa.array(on)
    made = {"q_idx": a.field("row_idx").take(pa.array(of[on])), "c_idx": b.field("row_idx").take(at), "n_core_jw": pa.array(jw[on], mask=np.isnan(jw[on]))}
    return on, made | {"hn_eq": pa.array((h == g)[on].astype(np.int32), mask=none[on]), "n_first_eq": pa.array(first[on].astype(np.int32)), "y": pa.array(true[on].astype(np.int32)), "rank": pa.array(rank[on].astype(np.int32))}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries, each with its matches (``true``; null without any)."""
    true = lambda: _truth(spark, sf_dir).groupBy(F.col("q").alias("id")).agg(F.collect_set("c").alias("true"))
    return _once(spark, sf_dir, "asked", lambda: _brief(spark, sf_dir).where("is_query").join(true(), "id", "left"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by the three features that ``score`` reads: where they are found, or, if one task cannot hold a country's
    pool, where their records meet. The first way leaves out most that ``_scored`` would drop."""
    seen, asked = _brief(spark, sf_dir), _asked(spark, sf_dir)
    both = asked.unionByName(seen.where("not is_query"), allowMissingColumns=True)
    x = F.struct(F.col("name").alias("core"), first_of(F.col("name")).alias("first"), house_number(F.col("addr")).try_cast("double").alias("num"), "row_idx", "true")
    packed = grid.worded(both.withColumn("x", x), CHANNELS, PLAN.blocking)
    names = ["country", "q", "c", "q_idx", "c_idx", "p", "y", "rank"]
    if packed:
        kind = "q_idx long, c_idx long, n_core_jw double, hn_eq int, n_first_eq int, y int, rank int"
        return score(grid.judged(packed, PLAN.blocking, _judge, kind)).select(names)
    pairs = grid.found(grid.best(grid.pack(seen, CHANNELS, PLAN.blocking), PLAN.blocking), PLAN.blocking)
    df = grid.meet(pairs.select("q", "c", "country", "rank"), asked.drop("country", "is_query"), seen.where("not is_query").drop("country", "is_query"))
    hn = features.house(house_number(F.col("a.addr")), house_number(F.col("b.addr")))["hn_eq"]
    made = {"n_core_jw": scorer([("s", "jw")])("a.name", "b.name")["s"], "hn_eq": hn, "n_first_eq": features.equal(first_of(F.col("a.name")), first_of(F.col("b.name")))}
    df = df.withColumns(made | {"y": F.coalesce(F.array_contains("a.true", F.col("c")).cast("int"), F.lit(0)), "q_idx": F.col("a.row_idx"), "c_idx": F.col("b.row_idx")})
    return score(df).select(names)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("p") >= FLOOR) | (F.col("y") == 1) | (F.col("rank") == 0)
    return _once(spark, sf_dir, "scored", lambda: _rated(spark, sf_dir).where(kept).drop("rank"))


def _decided(spark: SparkSession, sf_dir: str, threshold: float = 0.75, cap: int = 15, resolve: bool = True) -> DataFrame:
    if threshold < FLOOR:
        raise ValueError(f"scored pairs are kept from {FLOOR} on")
    return decide.decide(_scored(spark, sf_dir), threshold, cap, resolve, "q_idx", "c_idx")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the decision that is usual here, as a table: what reads them twice does not decide twice."""
    return _once(spark, sf_dir, "links", lambda: _decided(spark, sf_dir).select("q", "c", "p", "y"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.entity_scores(_links(spark, sf_dir), _entities(spark, sf_dir))


# --- SQL fragments --------------------------------------------------------------------------------------------------------

_LEGAL_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicon.LEGAL.items()) + "}"
_TLDS = ", ".join(f"'{t}'" for t in lexicon.TLDS)
_STOPS = ", ".join(f"'{t}'" for t in lexicon.INITIAL_STOPS)
W = f"with {world_sql('duckdb')}"
_COUNTRY5 = "coalesce(list_last(regexp_extract_all(address, '\\b([0-9]{5})(?:-[0-9]{4})?\\b', 1)), '')"
V = f"""{W}, v0 as (select *, {LATIN.format('name')} as name_latin, {LATIN.format('address')} as addr_plain, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as name_light from world),
v1 as (select *, list_filter(string_split(name_latin, ' '), lambda x: x <> '') as tk, list_filter(string_split(addr_plain, ' '), lambda x: x <> '') as ak, {_LEGAL_SQL} as lg from v0),
v2 as (select *, regexp_replace(array_to_string(list_filter(tk, lambda x: len(map_extract(lg, x)) = 0), ' '), '^((and|et)( |$))+|( (and|et))+$', '', 'g') as core0 from v1),
v3 as (select *, case when core0 = '' then name_latin else core0 end as name_core from v2),
v4 as (select *, string_split(name_core, ' ') as ck, regexp_matches(name, '(?i)(www\\.)|(\\.(com|net|org|in|co|fr|us|info|biz|io)\\b)') as dom from v3),
v as (select id, country, is_query, name, address, src, row_idx, name_light, name_latin, name_core, addr_plain, addr_plain as addr_latin,
  array_to_string(case when dom and len(list_filter(ck, lambda x: x not in ({_TLDS}))) > 0 then list_filter(ck, lambda x: x not in ({_TLDS})) else ck end, '') as name_compact,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(tk, lambda x: len(map_extract(lg, x)) > 0), lambda x: lg[x]))), ' ') as name_legal,
  ck[1] as name_first, array_to_string(list_transform(list_filter(tk, lambda x: x not in ({_STOPS})), lambda x: x[1]), '') as name_init,
  len(list_filter(ck, lambda x: x <> ''))::smallint as name_ntok, (name_latin = '')::int::tinyint as name_empty,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(ak, lambda t: regexp_full_match(t, '[0-9]+')), lambda t: case when regexp_full_match(t, '0+') then '0' else ltrim(t, '0') end))), ' ') as addr_num,
  case country when 'US' then {_COUNTRY5} when 'France' then {_COUNTRY5} when 'India' then coalesce(regexp_replace(list_last(regexp_extract_all(address, '\\b([0-9]{{3}}\\s?[0-9]{{3}})\\b', 1)), '\\s', '', 'g'), '') else '' end as addr_postal,
  case when country = 'France' then '' else regexp_extract(address, 'Unit ([0-9]+)', 1) end as addr_unit, len(list_filter(string_split(address, ','), lambda t: trim(t) <> ''))::smallint as addr_ncomp,
  (case when trim(address) = '' then 1 when addr_plain = '' then 3 else 0 end)::tinyint as addr_missing, nullif(regexp_extract(addr_plain, '(?:^|\\s)0*([0-9]+)', 1), '') as hnum from v4)"""
REC = f"{V}, rec as (select id, country, is_query, name_core as name, addr_plain as addr from v)"
CAND = f"{REC}{chain()}"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of short strings, by the bits of a 128-bit integer."""
    mask = f"list_reduce(list_concat([0::hugeint], list_transform(string_split({a}, ''), lambda z, i: case when z = ch then 1::hugeint << (i - 1) else 0::hugeint end)), lambda s, t: s | t)"
    full = f"((1::hugeint << length({a})) - 1)"
    return f"(case when {a} = '' or {b} = '' then 0 else length({a}) - bit_count(list_reduce(list_concat([{full}], list_transform(string_split({b}, ''), lambda ch: {mask})), lambda u, m: ((u + (u & m)) | (u - (u & m))) & {full})) end)"


def _ratio(a: str, b: str) -> str:
    return f"case when {a} <> '' and {b} <> '' then 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) end"


_FLAG_EQ = {"n_core_exact": "name_core", "n_first_eq": "name_first", "num_exact": "addr_num", "legal_same": "name_legal", "postal_eq": "addr_postal", "unit_eq": "addr_unit"}
_FLAG_NE = {"legal_conflict": "name_legal", "postal_conflict": "addr_postal", "unit_conflict": "addr_unit"}
_FLAGS = f"""{', '.join(f"(a.{v} <> '' and a.{v} = b.{v})::int as {n}" for n, v in _FLAG_EQ.items())}, {', '.join(f"(a.{v} <> '' and b.{v} <> '' and a.{v} <> b.{v})::int as {n}" for n, v in _FLAG_NE.items())},
(a.addr_num <> '')::int as q_has_num, (b.addr_num <> '')::int as c_has_num, a.addr_ncomp as q_ncomp, b.addr_ncomp as c_ncomp, b.addr_missing as c_addr_missing, 0::tinyint as q_deva, 0::tinyint as c_deva, 0 as cross_script,
0::tinyint as c_fixed, starts_with(b.id, 'S3-')::int as is_s3, a.name_ntok as q_ntok, b.name_ntok as c_ntok, round(least(length(a.name_core), length(b.name_core)) / greatest(length(a.name_core), length(b.name_core), 1), 6) as len_ratio,
(a.hnum is not null and b.hnum is not null)::int as hn_both, (a.hnum::double = b.hnum::double)::int as hn_eq, round(ln(1 + abs(a.hnum::double - b.hnum::double)), 6) as hn_absdiff,
case when a.hnum is not null and b.hnum is not null then round(abs(a.hnum::double - b.hnum::double) / greatest(a.hnum::double, b.hnum::double, 1.0), 6) end as hn_reldiff, levenshtein(a.hnum, b.hnum)::int as hn_lev,
(levenshtein(a.hnum, b.hnum) = abs(length(a.hnum) - length(b.hnum)) and length(a.hnum) <> length(b.hnum))::int as hn_trunc"""
_FLAG_NAMES = [*_FLAG_EQ, *_FLAG_NE, "q_has_num", "c_has_num", "q_ncomp", "c_ncomp", "c_addr_missing", "q_deva", "c_deva", "cross_script", "c_fixed", "is_s3", "q_ntok", "c_ntok", "len_ratio", "hn_both", "hn_eq", "hn_absdiff", "hn_reldiff", "hn_lev", "hn_trunc"]
SCORED_SQL = f"""{CAND}, sp as (select cand.country, cand.q, cand.c, a.row_idx as q_idx, b.row_idx as c_idx, (t.c is not null)::int as y,
  round(0.6 * coalesce(case when a.name_core <> '' and b.name_core <> '' then jaro_winkler_similarity(a.name_core, b.name_core) end, 0.0) + 0.3 * coalesce((a.hnum::double = b.hnum::double)::int::double, 0.3) + 0.1 * (a.name_first <> '' and a.name_first = b.name_first)::int, 6) as p
  from cand join v a on a.id = cand.q join v b on b.id = cand.c left join truth t on t.q = cand.q and t.c = cand.c),
ent as (select id as q, country, coalesce(n, 0)::bigint as tsize, row_idx from world left join (select q, count(*) as n from truth group by q) s on s.q = id where is_query)"""


def _run(s: str, threshold: float = 0.75, cap: int = 15, resolve: bool = True) -> str:
    """SQL of one decision and its entity scores: tables d{s} and f{s}."""
    best = f"select * from (select *, row_number() over (partition by c order by p desc, q_idx) as r from sp where p >= {threshold}) where r = 1" if resolve else f"select *, 1 as r from sp where p >= {threshold}"
    return f""", d{s} as (select q, c, p, y, c_idx from (select *, row_number() over (partition by q order by p desc, c_idx) as k from ({best})) where k <= {cap}),
m{s} as (select q, sum(y)::bigint as tp, count(*) as npred from d{s} group by q), e{s} as (select ent.q, country, tsize, coalesce(tp, 0) as tp, coalesce(npred, 0) as npred from ent left join m{s} m on ent.q = m.q),
f{s} as (select *, case when tsize = 0 then (npred = 0)::int::double when tp = 0 then 0 else 1.25 * (tp / npred) * (tp / tsize) / (0.25 * (tp / npred) + tp / tsize) end as f05 from e{s})"""


# --- records and truth ------------------------------------------------------------------------------------------------------


@query(f"{W} select src, country, count(*) as n, round(avg((trim(name) = '')::int), 6) as no_name, round(avg((trim(address) = '')::int), 6) as no_address, round(count(*) / sum(count(*)) over (partition by src), 6) as mix from world group by src, country")
def missingness(spark, sf_dir):
    return analyses.missingness(world(spark, sf_dir)[0])


@query(f"{W}, s as (select country, sum(is_query::int)::bigint as queries, sum((not is_query)::int)::bigint as pool from world group by country) select *, (queries > 0 and pool > 0)::int as both from s")
def country_table(spark, sf_dir):
    return analyses.country_table(world(spark, sf_dir)[0])


@query(f"{W}, p as (select id from world where not is_query) select 'repeated_ids' as check, (select count(*) from (select id from world group by id having count(*) > 1)) as n union all select 'unlisted_queries', (select count(*) from world where is_query and id not in (select q from truth)) union all select 'unknown_queries', 0 union all select 'unknown_matches', (select count(*) from (select distinct c from truth) where c not in (select id from p)) union all select 'shared_matches', 0")
def integrity(spark, sf_dir):
    records, truth = world(spark, sf_dir)
    return analyses.integrity(records, truth.select("q").distinct(), truth)


@query(f"{W}, s as (select src, count(*) as n, sum((id not in (select c from truth))::int)::bigint as orphans from world where not is_query group by src) select *, round(orphans / n, 6) as share from s")
def orphan_share(spark, sf_dir):
    return analyses.orphan_share(*world(spark, sf_dir))


@query(f"{W} select count(*) as pairs, round(avg((a.country = b.country)::int), 6) as same from truth join world a on a.id = q join world b on b.id = c")
def within_country(spark, sf_dir):
    return analyses.within_country(*world(spark, sf_dir))


@query(f"{SCORED_SQL} select country, tsize, count(*) as n from ent group by all")
def truth_sizes(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("country", "tsize").agg(F.count("*").alias("n"))


@query(f"{W} select country, round(count(*) / sum(count(*)) over (), 4) as w from world where is_query and country in (select distinct country from world where not is_query and country <> 'Germany') group by country")
def test_weights(spark, sf_dir):
    records = world(spark, sf_dir)[0]
    return decide.weights_of(records.where("is_query"), records.where("not is_query and country <> 'Germany'"))


_VIEW_NAMES = ["id", "name_light", "name_latin", "name_core", "name_compact", "name_legal", "name_first", "name_init", "name_ntok", "name_empty", "addr_plain", "addr_latin", "addr_num", "addr_postal", "addr_unit", "addr_ncomp", "addr_missing", "hnum"]


@query(f"{V} select {', '.join(_VIEW_NAMES)} from v")
def views(spark, sf_dir):
    return _views(spark, sf_dir).select(_VIEW_NAMES)


@query(f"""{W}, s as (select q, count(*) as n from truth group by q), r as (select id as q, country, case when coalesce(n, 0) < 2 then coalesce(n, 0) when n < 4 then 2 when n < 6 then 3 else 4 end as bucket from world left join s on s.q = id where is_query),
dr as (select q from r where ('0x' || substr(md5(q || '|' || country || '|' || bucket || '|mini'), 1, 8))::bigint / 4294967296.0 < 0.2),
mi as (select c as id from truth where q in (select q from dr)), al as (select id from world where not is_query and id not in (select c from truth) and ('0x' || substr(md5(id || '|mini'), 1, 8))::bigint / 4294967296.0 < 0.2)
select q as id, 1 as is_query from dr union all select id, 0 from mi union all select id, 0 from al""")
def mini_sample(spark, sf_dir):
    records, truth = world(spark, sf_dir)
    drawn, pool = sampling.clusters(records.where("is_query").select(F.col("id").alias("q"), "country"), truth, records.where("not is_query"), 0.2)
    return drawn.select(F.col("q").alias("id"), F.lit(1).alias("is_query")).unionByName(pool.select("id", F.lit(0).alias("is_query")))


@query(f"{W} select id as q from world where is_query and row_idx % 10 = 0 order by md5(id || '|holdout'), id limit 100")
def holdout(spark, sf_dir):
    records = world(spark, sf_dir)[0].where("is_query").select(F.col("id").alias("q"), F.when(F.col("row_idx") % 10 == 0, "holdout").otherwise("train").alias("split"))
    return sampling.holdout(records, 100)


# --- blocking -----------------------------------------------------------------------------------------------------------------


@query(f"{CAND} select country, q, c, round(blk, 6) as blk, round(ncos, 6) as ncos, round(acos, 6) as acos, rank, in_name from cand")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("country", "q", "c", *[F.round(x, 6).alias(x) for x in ("blk", "ncos", "acos")], "rank", "in_name")


@query(f"{CAND} select i.country, i.channel, any_value(n) as pool, count(distinct i.tok) as vocab, count(*) as nnz from pv i join sz on i.country = sz.country group by i.country, i.channel")
def index_stats(spark, sf_dir):
    base = _views(spark, sf_dir).select("country", "id", "is_query", F.col("name_core").alias("name"), F.col("addr_plain").alias("addr"))
    return blocking.stats(blocking.index(base, CHANNELS, PLAN.blocking), blocking.postings(base, CHANNELS))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).select("country", "id", "is_query", F.col("name_core").alias("name"), F.col("addr_plain").alias("addr"))


_FRACS = [0.001, 0.005, 0.02]


@query(sweep_sql(REC, _FRACS))
def cap_sweep(spark, sf_dir):
    return grid.sweep(_base(spark, sf_dir), CHANNELS, _truth(spark, sf_dir), PLAN.blocking, _FRACS)


_VARIANT_ROWS = " union all ".join(f"select '{n}' as variant, " + ", ".join(f"round(sum((coalesce(x.rank, 1000000) < {k})::int) / count(*), 6) as recall_{k}" for k in (10, 20, 50)) + f" from truth t left join cand_{n} x on x.q = t.q and x.c = t.c" for n in ("candidate", "full", "none"))


@query(f"{REC}{''.join(chain(0.005, f'_{n}', n, 50, 0) for n in ('candidate', 'full', 'none'))} {_VARIANT_ROWS}")
def ranking_variants(spark, sf_dir):
    return grid.variants(_base(spark, sf_dir), CHANNELS, _truth(spark, sf_dir), PLAN.blocking)


_GRAM = "list_transform(range(1, greatest(length({x}) - {n} + 1, 1) + 1), lambda i: substr({x}, i, {n}))"
_WORD_GRAMS = "array_to_string(list_distinct(flatten(list_transform(list_filter(string_split({v}, ' '), lambda w: w <> ''), lambda w: list_concat(" + _GRAM.format(x="('_' || w || '_')", n=3) + ", " + _GRAM.format(x="('_' || w || '_')", n=4) + ")))), ' ')"


@query(f"{V}, rec as (select id, country, is_query, {_WORD_GRAMS.format(v='name_core')} as name, addr_plain as addr from v){chain()} select count(*) as found, round(count(*) / (select count(*) from truth), 6) as recall from truth t join cand x on x.q = t.q and x.c = t.c")
def gram_blocker(spark, sf_dir):
    base = _base(spark, sf_dir).withColumn("name", analyses.word_grams(F.col("name")))
    return grid.recall(base, CHANNELS, _truth(spark, sf_dir), PLAN.blocking)


@query(f"""{REC}{chain()}, few as (select country, channel, tok from dfq where df <= 20), pp as (select p.* from post p join few f on p.country = f.country and p.channel = f.channel and p.tok = f.tok),
met as (select distinct a.id as q, b.id as c from pp a join pp b on a.country = b.country and a.channel = b.channel and a.tok = b.tok where a.is_query and not b.is_query),
per as (select r.id as q, count(met.c) as n, count(t.c) as hit from rec r left join met on met.q = r.id left join truth t on t.q = met.q and t.c = met.c where is_query group by r.id)
select count(*) as n_q, sum(n)::bigint as pairs, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.95) as p95, max(n) as most, round(sum(hit) / (select count(*) from truth), 6) as recall from per""")
def union_blocker(spark, sf_dir):
    return analyses.union_blocker(_base(spark, sf_dir), CHANNELS, _truth(spark, sf_dir), 20)


_TRI = "case when {v} = '' then [] else list_distinct(" + _GRAM.format(x="replace({v}, ' ', '')", n=3) + ") end"
_WORDS = "list_distinct(list_filter(string_split({v}, ' '), lambda z: z <> ''))"


@query(f"""{V}, b as (select a.name_core as n1, b.name_core as n2, a.addr_plain as a1, b.addr_plain as a2, a.addr_postal as p1, b.addr_postal as p2 from truth join v a on a.id = q join v b on b.id = c)
select count(*) as pairs, sum(list_has_any({_WORDS.format(v='n1')}, {_WORDS.format(v='n2')})::int)::bigint as name_token, sum((n1 <> '' and split_part(n1, ' ', 1) = split_part(n2, ' ', 1))::int)::bigint as first_token, sum((n1 <> '' and left(n1, 4) = left(n2, 4))::int)::bigint as prefix4, sum((n1 <> '' and left(n1, 6) = left(n2, 6))::int)::bigint as prefix6,
sum(list_has_any({_TRI.format(v='n1')}, {_TRI.format(v='n2')})::int)::bigint as trigram, sum(list_has_any({_WORDS.format(v='a1')}, {_WORDS.format(v='a2')})::int)::bigint as addr_token, sum((p1 <> '' and p1 = p2)::int)::bigint as postal from b""")
def key_recall(spark, sf_dir):
    return analyses.key_recall(_views(spark, sf_dir), _truth(spark, sf_dir))


_JAC = "coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


@query(f"""{SCORED_SQL}, b as (select y, x.name_core as n1, z.name_core as n2 from sp join v x on x.id = q join v z on z.id = sp.c)
select y, count(*) as n, round(avg({_JAC.format(x=_WORDS.format(v='n1'), y=_WORDS.format(v='n2'))}), 6) as tokens, round(avg({_JAC.format(x=_TRI.format(v='n1'), y=_TRI.format(v='n2'))}), 6) as trigrams, round(avg((n1 = n2 and n1 <> '')::int), 6) as exact from b group by y""")
def separability(spark, sf_dir):
    return analyses.separability(_views(spark, sf_dir), _pairs(spark, sf_dir))


# --- features -------------------------------------------------------------------------------------------------------------------


@query(f"{CAND} select q, cand.c, {_FLAGS} from cand join v a on a.id = q join v b on b.id = cand.c")
def flags(spark, sf_dir):
    rounded = ("len_ratio", "hn_absdiff", "hn_reldiff")
    seen = _views(spark, sf_dir)
    df = grid.meet(_candidates(spark, sf_dir).select("q", "c"), seen.where("is_query"), seen.where("not is_query"))
    made = features.flags("a", "b")
    return df.select("q", "c", *[(F.round(made[n], 6) if n in rounded else made[n]).alias(n) for n in _FLAG_NAMES])


_SORTED = "array_to_string(list_sort(list_filter(string_split({v}, ' '), lambda z: z <> '')), ' ')"
_REST = "array_to_string(list_sort(list_filter(list_distinct(string_split({a}, ' ')), lambda z: z <> '' and not list_contains(string_split({b}, ' '), z))), ' ')"
_BOTH = "array_to_string(list_sort(list_filter(list_distinct(string_split({a}, ' ')), lambda z: z <> '' and list_contains(string_split({b}, ' '), z))), ' ')"


def _tset(x: str, y: str, s: str, a: str, b: str) -> str:
    """Token-set ratio from the rests x and y and the shared part s of two strings."""
    gap = f"({s} > 0)::int"
    one = f"100.0 * (1 - (length({x}) + length({y}) - 2 * {_lcs(x, y)}) / greatest({s} + {gap} + length({x}) + {s} + {gap} + length({y}), 1))"
    side = lambda r: f"100.0 * (1 - ({gap} + length({r})) / ({s} + {s} + {gap} + length({r})))"
    return f"case when {a} = '' or {b} = '' then null when {s} > 0 and ({x} = '' or {y} = '') then 100.0 when {s} > 0 then greatest({one}, {side(x)}, {side(y)}) else {one} end"


_TSET_VIEWS = {"n_core_tset": "name_core", "n_latin_tset": "name_latin", "a_plain_tset": "addr_plain", "num_tset": "addr_num"}


def _tset_sql(name: str, view: str) -> str:
    return f"""{name}_0 as (select distinct a.{view} as a, b.{view} as b from cand join v a on a.id = q join v b on b.id = cand.c),
{name}_1 as (select a, b, {_REST.format(a='a', b='b')} as x, {_REST.format(a='b', b='a')} as y, length({_BOTH.format(a='a', b='b')}) as s from {name}_0),
{name}_2 as (select a, b, {_tset('x', 'y', 's', 'a', 'b')} as score from {name}_1)"""


@query(f"{CAND}, {', '.join(_tset_sql(n, v) for n, v in _TSET_VIEWS.items())} select q, cand.c, {', '.join(f'round({n}_2.score, 6) as {n}' for n in _TSET_VIEWS)} from cand join v a on a.id = q join v b on b.id = cand.c {' '.join(f'join {n}_2 on {n}_2.a = a.{v} and {n}_2.b = b.{v}' for n, v in _TSET_VIEWS.items())}")
def token_sets(spark, sf_dir):
    return _pairs(spark, sf_dir).select("q", "c", *[F.round(n, 6).alias(n) for n in _TSET_VIEWS])


_RATIOS = {"n_core_ratio": "name_core", "n_latin_ratio": "name_latin", "n_compact_ratio": "name_compact", "n_light_ratio": "name_light", "a_ratio": "addr_latin"}


@query(f"""{CAND}, x as (select q, cand.c, a.name_core as a1, b.name_core as b1, {', '.join(f'a.{v} as a_{n}, b.{v} as b_{n}' for n, v in _RATIOS.items())}, {_SORTED.format(v='a.name_core')} as sa, {_SORTED.format(v='b.name_core')} as sb from cand join v a on a.id = q join v b on b.id = cand.c)
select q, c, {', '.join(f'round({_ratio(f"a_{n}", f"b_{n}")}, 6) as {n}' for n in _RATIOS)}, round({_ratio('sa', 'sb')}, 6) as n_core_tsort, case when a1 <> '' and b1 <> '' then round(jaro_winkler_similarity(a1, b1), 6) end as n_core_jw from x""")
def ratios(spark, sf_dir):
    return _pairs(spark, sf_dir).select("q", "c", *[F.round(n, 6).alias(n) for n in [*_RATIOS, "n_core_tsort", "n_core_jw"]])


@query(f"{CAND} select q, c, count(*) over (partition by q) as n_cand, round(blk / greatest(max(blk) over (partition by q), 1e-6), 6) as blk_rel, round(max(blk) over (partition by q) - blk, 6) as blk_gap from cand")
def within_query(spark, sf_dir):
    return _pairs(spark, sf_dir).select("q", "c", "n_cand", F.round("blk_rel", 6).alias("blk_rel"), F.round("blk_gap", 6).alias("blk_gap"))


@query(f"""{V}, p as (select * from v where not is_query), n as (select country, count(*) as n from p group by country), k as (select country, name_core, count(*) as m from p where name_core <> '' group by all), a as (select country, addr_plain, count(*) as m from p where addr_plain <> '' group by all)
select v.id, round(case when v.name_core <> '' then coalesce(k.m, 1) * 1e5 / coalesce(n.n, 1) end, 6) as name_dup, round(case when v.addr_plain <> '' then coalesce(a.m, 1) * 1e5 / coalesce(n.n, 1) end, 6) as addr_dup
from v left join n on v.country = n.country left join k on v.country = k.country and v.name_core = k.name_core left join a on v.country = a.country and v.addr_plain = a.addr_plain where v.is_query""")
def pool_rates(spark, sf_dir):
    """How frequent the names and addresses of queries are in the pool."""
    seen = _views(spark, sf_dir)
    out = features.frequency_rates(seen.where("is_query"), {"name_dup": "name_core", "addr_dup": "addr_plain"}, seen.where("not is_query"))
    return out.select("id", F.round("name_dup", 6).alias("name_dup"), F.round("addr_dup", 6).alias("addr_dup"))


# --- decisions and runs -----------------------------------------------------------------------------------------------------------


@query(f"{SCORED_SQL}{_run('')} select country, {MEANS} from f group by country")
def f05(spark, sf_dir):
    return decide.report(_judged(spark, sf_dir), ("country",))


def _grid_sql(grid: list[float]) -> str:
    runs = "".join(_run(f"_{k}", t) for k, t in enumerate(grid))
    return runs + ", g as (" + " union all ".join(f"select {t}::double as thr, * from f_{k}" for k, t in enumerate(grid)) + ")"


_GRID = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9]
_TUNED = f"pc as (select thr, g.country, avg(f05) as m, any_value(w) as w from g left join {_WEIGHTS} on g.country = w.country group by thr, g.country), tm as (select thr, round(sum(w * m) / sum(w), 6) as f05_testmix from pc group by thr)"


@query(f"{SCORED_SQL}{_grid_sql(_GRID)}, {_TUNED} select g.thr, {MEANS}, any_value(f05_testmix) as f05_testmix from g join tm on g.thr = tm.thr group by g.thr order by f05_testmix desc, g.thr limit 1")
def tuned_threshold(spark, sf_dir):
    weights = spark.createDataFrame([("US", 0.4), ("India", 0.45), ("France", 0.15)], "country string, w double")
    pairs = _scored(spark, sf_dir)
    return decide.tuned(decide.threshold_grid(pairs, _entities(spark, sf_dir), _GRID, weights=weights))


@query(f"""{SCORED_SQL}{_grid_sql(_GRID)}, o as (select country, thr, sum(f05) as s, count(*) as n from g group by all), l as (select distinct country from sp),
aw as (select l.country, thr, round(sum(s) / sum(n), 6) as m from l join o on o.country <> l.country group by all), pick as (select country, thr from (select *, row_number() over (partition by country order by m desc, thr) as r from aw) where r = 1)
select l.country, pick.thr, round(o.s / o.n, 6) as f05, (select max(round(s / n, 6)) from o o2 where o2.country = l.country) as in_country from l join pick on pick.country = l.country join o on o.country = l.country and o.thr = pick.thr""")
def leave_one_out(spark, sf_dir):
    """The formula needs no training. Records go by their input position here, which is short and what ties follow."""
    pairs = _scored(spark, sf_dir).select("country", F.col("q_idx").alias("q"), F.col("c_idx").alias("c"), "p", "y")
    sizes = F.coalesce(F.array_size("true"), F.lit(0)).cast("long").alias("tsize")
    return matcher.leave_one_out(pairs, _asked(spark, sf_dir).select(F.col("row_idx").alias("q"), "country", sizes), [], _GRID)


_TRIALS = {"no_resolve": {"resolve": False}, "cap_2": {"cap": 2}, "thr_080": {"threshold": 0.8}, "thr_060": {"threshold": 0.6}}


def _gate_sql() -> str:
    rows = []
    for name in _TRIALS:
        per = f"select z.country, count(*) as n, avg(z.f05 - b.f05) as m, var_pop(z.f05 - b.f05) * count(*) as ss from f_{name} z join f_base b on z.q = b.q group by z.country"
        rows.append(f"select '{name}' as rule, sum(w * m) / sum(w) as d, sqrt(sum((w / n) ** 2 * ss)) / sum(w) as s from ({per}) k join {_WEIGHTS} on k.country = w.country")
    runs = _run("_base") + "".join(_run(f"_{name}", **how) for name, how in _TRIALS.items())
    return f"{SCORED_SQL}{runs}, k as ({' union all '.join(rows)}), r as (select rule, round(d, 6) as delta, round(s, 6) as se from k) select *, (delta > 0 and delta > 2 * se)::int as adopted from r"


@query(_gate_sql())
def switch_gate(spark, sf_dir):
    weights = spark.createDataFrame([("US", 0.4), ("India", 0.45), ("France", 0.15)], "country string, w double")
    runs = decide.trials(_scored(spark, sf_dir), _entities(spark, sf_dir), {"base": {}} | _TRIALS, "q_idx", "c_idx")
    runs = table(runs, "trials")
    freed(spark)
    of = lambda name: runs.select("q", "country", F.col(f"f05_{name}").alias("f05"))
    return matcher.gate(of("base"), {name: of(name) for name in _TRIALS}, weights)


@query(f"{SCORED_SQL}{_run('')} select ent.q, coalesce(string_agg(c, ',' order by p desc, c), '') as matched_ids from ent left join d on ent.q = d.q group by ent.q")
def matching_results(spark, sf_dir):
    return linkage.decide.lists(_decided(spark, sf_dir), _entities(spark, sf_dir), [(-F.col("p")).alias("o"), F.col("c").alias("o2")], "matched_ids")


_STEPS = [0.7, 0.8, 0.9]
_VARIANT_SQL = f"{SCORED_SQL}{''.join(_run(f'_{k}', t) for k, t in enumerate(_STEPS))}, vt as (" + " union all ".join(f"select {t}::double as thr, ent.q, coalesce(string_agg(c, ',' order by p desc, c), '') as matched_ids, count(c) as n from ent left join d_{k} d on ent.q = d.q group by ent.q" for k, t in enumerate(_STEPS)) + ")"


@query(f"{_VARIANT_SQL} select thr, q, matched_ids from vt")
def threshold_variants(spark, sf_dir):
    return linkage.variants(_scored(spark, sf_dir), _entities(spark, sf_dir), _STEPS, 15, "q_idx", "c_idx")


@query(f"{_VARIANT_SQL} select thr, sum(n)::bigint as links, round(avg(n), 6) as per_query, round(avg((n = 0)::int), 6) as empty from vt group by thr")
def threshold_profile(spark, sf_dir):
    return analyses.threshold_profile(linkage.variants(_scored(spark, sf_dir), _entities(spark, sf_dir), _STEPS, 15, "q_idx", "c_idx"))


@query(f"""{SCORED_SQL}{_run('')}, s3 as (select country, round(avg(starts_with(c, 'S3-')::int), 6) as s3_share from d join ent on d.q = ent.q group by country)
select f.country, count(*) as n, round(avg(npred), 6) as mean_pred, round(avg((npred = 0)::int), 6) as empty, round(avg((npred >= 6)::int), 6) as six_or_more, coalesce(any_value(s3_share), 0.0) as s3_share, {" || ',' || ".join(f"sum((least(npred, 6) = {k})::int)::bigint" for k in range(7))} as histogram from f left join s3 on f.country = s3.country group by f.country""")
def prediction_profile(spark, sf_dir):
    return analyses.prediction_profile(_judged(spark, sf_dir), _links(spark, sf_dir))


@query(f"""{SCORED_SQL}{_run('')}, fp as (select 'FP' as kind, q, c, p from d where y = 0), fn as (select 'FN' as kind, q, c, p from sp where y = 1 and (q, c) not in (select (q, c) from d))
select * from (select * from fp order by md5(q || '|' || c || '|errors'), q, c limit 8) union all select * from (select * from fn order by md5(q || '|' || c || '|errors'), q, c limit 8)""")
def error_examples(spark, sf_dir):
    return decide.errors(_scored(spark, sf_dir), _links(spark, sf_dir))


@query(f"""{SCORED_SQL}{_run('')} select 'missing' as check, 0 as n union all select 'unknown', 0 union all select 'repeated', 0 union all select 'outside', (select count(*) from d where (q, c) not in (select (q, c) from cand)) union all select 'used_twice', (select count(*) from (select c from d group by c having count(*) > 1))""")
def output_checks(spark, sf_dir):
    ent, pairs = _entities(spark, sf_dir), _scored(spark, sf_dir)
    return io.violations(ent.select("q").join(_decided(spark, sf_dir).select("q", "c"), "q", "left"), pairs, ent)


@query()
def trained_matcher(spark, sf_dir):
    """Trees trained on half of the queries, by hash; the macro means of the other half at the tuned threshold."""
    ent, pairs = _entities(spark, sf_dir), _pairs(spark, sf_dir)
    half = sampling.unit_hash(F.col("q"), "half") < 0.5
    run = linkage.fit_and_validate(pairs, ent.where(half), ent.where(~half), rounds=20)
    rows = [(name, run["threshold"], *[float(run[name][k] if run[name][k] is not None else -1) for k in ("f05", "mean_p", "mean_r", "singleton_acc")]) for name in ("resolve_true", "resolve_false")]
    return spark.createDataFrame(rows, "run string, thr double, f05 double, mean_p double, mean_r double, singleton_acc double")
