"""A labelled world of business records made from the customer tables, the same in any SQL engine.

Each customer is a query record of a made-up business. Its matches are noisy copies of it in the pool; further pool records
match nothing. All choices hang on the MD5 of a key, so two engines that run this text make the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: How an engine writes the first 32 bits of an MD5 as an integer, and whole division.
_HASH = {"spark": "cast(conv(substr(md5(concat({k}, '|{s}')), 1, 8), 16, 10) as bigint)", "duckdb": "cast('0x' || substr(md5(concat({k}, '|{s}')), 1, 8) as bigint)"}
#: Shares of businesses with 0, 1, ... matches.
SHARES = (0.0558, 0.0540, 0.1700, 0.2405, 0.2194, 0.1459, 0.0747, 0.0290, 0.0107)
_CONSONANTS, _VOWELS = "bcdfghjklmnprstv", "aeiouaeiouaeioua"

#: Customers whose records one task makes.
SPREAD = 25_000


def _word(key: str, salt: str, syllables: int) -> str:
    """A made-up word: hex digits of an MD5 spelled as consonants and vowels in turn."""
    m = f"md5(concat({key}, '|{salt}'))"
    return "concat(" + ", ".join(f"translate(substr({m}, {i + 1}, 1), '0123456789abcdef', '{_VOWELS if i % 2 else _CONSONANTS}')" for i in range(2 * syllables)) + ")"


def world_sql(engine: str) -> str:
    """Common table expressions ``world`` (id, country, is_query, name, address, src, row_idx) and ``truth`` (q, c)."""
    h = lambda k, s: _HASH[engine].format(k=k, s=s)
    steps, at = [], 0.0
    for n, share in enumerate(SHARES[:-1]):
        at += share
        steps.append(f"when {h('k', 'm')} < {round(at * 2**32)} then {n}")
    suffix = lambda x: f"case {x} when 0 then '' when 1 then ' Inc' when 2 then ' LLC' when 3 then ' Pvt Ltd' when 4 then ' SARL' else ' & Co' end"
    street = lambda x: f"case {x} when 0 then 'Road' when 1 then 'Rd' when 2 then 'Avenue' else 'Ave' end"

    def noisy(p: str, name: str) -> str:
        at = f"({h('key', 'at')} % greatest(length({name}), 1) + 1)"
        return f"""case {p} when 1 then concat(substr({name}, 1, cast({at} - 1 as int)), substr({name}, cast({at} + 1 as int)))
            when 2 then concat(substr({name}, 1, cast({at} - 1 as int)), substr({name}, cast({at} + 1 as int), 1), substr({name}, cast({at} as int), 1), substr({name}, cast({at} + 2 as int)))
            when 3 then upper({name}) when 4 then concat('-- ', {name}) when 5 then concat(w1, replace(w2, ' ', ''), '.com') when 6 then replace({name}, 'e', 'é') else {name} end"""

    number = "case when 8 in (p1, p2) then concat('00', house) when 9 in (p1, p2) and house > 9 then substr(cast(house as varchar(9)), 1, length(cast(house as varchar(9))) - 1) else cast(house as varchar(9)) end"
    return f"""cust as (select c_custkey as k, c_mktsegment as seg, n_name as city, r_name as region,
    case when c_custkey % 101 = 0 then 'Atlantis' when c_custkey % 97 = 0 then 'Germany' when c_nationkey % 3 = 0 then 'US' when c_nationkey % 3 = 1 then 'India' else 'France' end as country
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
keys as (select *, k as own, 0 as orphan, case {' '.join(steps)} else {len(SHARES) - 1} end as n from cust
    union all select *, k + 100000000 as own, 1 as orphan, case when k % 5 = 0 then 2 else 1 end as n from cust),
ents as (select *, {_word('own', 'w1', 3)} as w1, {_word('own', 'w2', 2)} as w2, {_word(h('own', 'st') + ' % 400', 'street', 2)} as street, {h('own', 'a')} % 9000 + 1 as house, {h('own', 'sx')} % 6 as sfx, {h('own', 'ty')} % 4 as typ from keys),
copies as (select *, concat(cast(own as varchar(20)), ':', cast(j as varchar(2))) as key from ents join (select 1 as j union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8) js on j <= n where country <> 'Atlantis'),
ops as (select *, {h('key', 'p1')} % 12 as p1, {h('key', 'p2')} % 12 as p2, concat(w1, ' ', w2, ' ', lower(seg), {suffix(f"case when {h('key', 's')} % 4 = 0 then {h('key', 'sx')} % 6 else sfx end")}) as name0 from copies),
one as (select *, {noisy('p1', 'name0')} as name1, {number} as num, concat(street, ' ', {street(f"case when 10 in (p1, p2) then {h('key', 'ty')} % 4 else typ end")}, case when 11 in (p1, p2) then concat(', Unit ', {h('key', 'u')} % 50 + 1) else '' end) as road from ops),
pool as (select concat(case when {h('key', 'src')} % 2 = 0 then 'S2-' else 'S3-' end, cast(own * 16 + j as varchar(20))) as id, country, k, orphan, {noisy('p2', 'name1')} as name,
    case when {h('key', 'e')} % 100 < 3 then '' when 7 in (p1, p2) then concat(city, ', ', num, ' ', road, ', ', region) else concat(num, ' ', road, ', ', city, ', ', region) end as address, own * 16 + j as row_idx from one),
world as (select concat('S1-', k) as id, country, true as is_query, concat(w1, ' ', w2, ' ', lower(seg), {suffix('sfx')}) as name, concat(house, ' ', street, ' ', {street('typ')}, ', ', city, ', ', region) as address, 'S1' as src, k as row_idx from ents where orphan = 0
    union all select id, country, false, name, address, substr(id, 1, 2), row_idx from pool),
truth as (select concat('S1-', k) as q, id as c from pool where orphan = 0)"""


def _made(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region")}
    parts = -(-tables["customer"].count() // SPREAD)
    if parts > 1:  # each customer becomes many records, so a small file is dealt out first
        tables["customer"] = tables["customer"].select("c_custkey", "c_mktsegment", "c_nationkey").repartition(parts)
    text = world_sql("spark")
    for t in tables:
        text = text.replace(f"from {t} ", f"from {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(f"with {text} select * from {wanted}", **tables)


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, truth)."""
    return _made(spark, sf_dir, "world"), _made(spark, sf_dir, "truth")
