"""Parallel views of record names and addresses, as column expressions over latinised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import latin as scripts
from tessera.operators import lexicon as lex


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def first_of(text: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(text), F.lit(1)), F.lit(""))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), lex.CONTROL, " ")


def mended(df: DataFrame, column: str, mend: bool) -> DataFrame:
    """``df`` with ``column`` cleaned, garbled encodings read again if ``mend``, and ``__fixed``: whether that changed any so far."""
    raw = clean(F.col(column))
    before = F.col("__fixed") if "__fixed" in df.columns else F.lit(0)
    if not mend:
        return df.withColumn("__fixed", before).withColumn(column, raw)
    new = F.when(raw.rlike(lex.MOJIBAKE), scripts.repair(raw)).otherwise(raw)
    df = df.withColumn("__raw", raw).withColumn(column, new)
    return df.withColumn("__fixed", F.greatest(before, (F.col("__raw") != F.col(column)).cast("int"))).drop("__raw")


def name_views(df: DataFrame, name: str = "name", by_sound: bool = False) -> DataFrame:
    """``df`` with name_light, name_latin, name_core, name_compact, name_legal, name_first, name_alias, name_init,
    name_ntok, name_empty and deva. A null name counts as empty."""
    raw, to_latin = clean(F.col(name)), scripts.to_latin_by_sound if by_sound else scripts.to_latin
    df = df.withColumn("name_light", scripts.to_light(raw)).withColumn("name_latin", to_latin(raw)).withColumn("__alias", to_latin(F.regexp_extract(raw, lex.ALIAS + "(.*)$", 1)))
    toks, legal = tokens(F.col("name_latin")), _map(lex.LEGAL)
    core = F.array_join(F.filter(toks, lambda t: ~t.isin(*lex.LEGAL)), " ")
    core = F.regexp_replace(core, r"^(?:(?:and|et)(?: |$))+|(?: (?:and|et))+$", "")
    df = df.withColumn("name_core", F.when(core == "", F.col("name_latin")).otherwise(core))
    plain = F.filter(tokens(F.col("name_core")), lambda t: ~t.isin(*lex.TLDS))
    compact = F.when(raw.rlike(lex.DOMAIN) & (F.size(plain) > 0), F.array_join(plain, "")).otherwise(F.array_join(tokens(F.col("name_core")), ""))
    return df.withColumns({
        "name_compact": compact,
        "name_legal": F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(toks, lambda t: t.isin(*lex.LEGAL)), lambda t: legal[t]))), " "),
        "name_first": first_of(F.col("name_core")),
        "name_alias": F.array_join(F.filter(tokens(F.col("__alias")), lambda t: ~t.isin(*lex.LEGAL)), " "),
        "name_init": F.array_join(F.transform(F.filter(toks, lambda t: ~t.isin(*lex.INITIAL_STOPS)), lambda t: F.substring(t, 1, 1)), ""),
        "name_ntok": F.size(tokens(F.col("name_core"))).cast("short"),
        "name_empty": (F.col("name_latin") == "").cast("byte"),
        "deva": raw.rlike(r"[ऀ-ॿ]").cast("byte"),
    }).drop("__alias")


def postal(raw: Column, country: Column) -> Column:
    """The last postal code by the country's pattern, without blanks; empty for other countries."""
    out = F.lit("")
    for label, pattern in lex.POSTAL.items():
        hit = F.try_element_at(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), F.lit(-1))
        out = F.when(country == label, F.coalesce(F.regexp_replace(hit, r"\s", ""), F.lit(""))).otherwise(out)
    return out


def unit(raw: Column, country: Column) -> Column:
    """Sorted distinct unit numbers."""
    ids = F.transform(F.regexp_extract_all(raw, F.lit(lex.UNIT), F.lit(1)), lambda u: F.regexp_replace(F.lower(u), "[-/]", ""))
    ids = F.transform(ids, lambda u: F.when(u.rlike(r"^\d+$"), F.regexp_replace(u, r"^0+(?=\d)", "")).otherwise(u))
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(ids, lambda u: u != ""))), " ")
    return F.when(country.isin(*lex.UNIT_SKIP), "").otherwise(found)


def numbers(plain: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(tokens(plain), lambda t: t.rlike(r"^\d+$")), lambda t: F.regexp_replace(t, r"^0+(?=\d)", "")))), " ")


def house_number(plain: Column) -> Column:
    """First number of an address as written digits, without leading zeros; null if there is none."""
    return F.nullif(F.regexp_extract(plain, r"(?:^|\s)0*(\d+)", 1), F.lit(""))


def address_views(df: DataFrame, address: str = "address", country: str = "country", states: bool = False, streets: bool = False,
                  placeholders: bool = False, by_sound: bool = False) -> DataFrame:
    """``df`` with addr_plain, addr_latin, addr_num, addr_postal, addr_unit, addr_ncomp, addr_missing, addr_empty, hnum."""
    raw, label = clean(F.col(address)), F.col(country)
    hollow = F.lower(F.trim(raw)).isin(*lex.PLACEHOLDERS) if placeholders else F.lit(False)
    df = df.withColumn("__hollow", hollow).withColumn("__raw", F.when(hollow, "").otherwise(raw))
    raw = F.col("__raw")
    df = df.withColumn("__parts", (scripts.latin_components_by_sound if by_sound else scripts.latin_components)(raw))
    plain = F.array_join(F.col("__parts"), " ")
    mapped = F.lit(None).cast("array<string>")
    for name in lex.STREETS:
        mapped = F.when(label == name, _components(name, states, streets)).otherwise(mapped)
    df = df.withColumn("addr_plain", plain).withColumn("addr_latin", F.array_join(F.coalesce(mapped, F.col("__parts")), " "))
    missing = F.when(F.col("__hollow"), 2).when(F.trim(raw) == "", 1).when(F.col("addr_plain") == "", 3).otherwise(0)
    return df.withColumns({
        "addr_num": numbers(F.col("addr_plain")), "addr_postal": postal(raw, label), "addr_unit": unit(raw, label),
        "addr_ncomp": F.size(F.filter(F.split(raw, ","), lambda p: F.trim(p) != "")).cast("short"),
        "addr_missing": missing.cast("byte"), "addr_empty": (missing != 0).cast("byte"), "hnum": house_number(F.col("addr_plain")),
    }).drop("__raw", "__hollow", "__parts")


def record_views(df: DataFrame, states: bool = False, streets: bool = False, placeholders: bool = False, by_sound: bool = False, mend: bool = False) -> DataFrame:
    """All views of records (name, address, country); ``fixed`` says whether mending changed name or address."""
    df = mended(mended(df, "name", mend), "address", mend)
    df = address_views(name_views(df, by_sound=by_sound), states=states, streets=streets, placeholders=placeholders, by_sound=by_sound)
    return df.withColumn("fixed", F.col("__fixed").cast("byte")).drop("__fixed")


def _components(country: str, states: bool, streets: bool) -> Column:
    return F.transform("__parts", lambda p: _component(p, country, states, streets))


def _component(part: Column, country: str, states: bool, streets: bool) -> Column:
    toks, out = tokens(part), part
    if streets and country in lex.STREETS:
        street = _map(lex.STREETS[country])
        out = F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(street, t), t)), " ")
    if states and country in lex.STATES:
        state, rest = _map(lex.STATES[country]), F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1)))
        hit = F.try_element_at(state, F.try_element_at(toks, F.lit(1)))
        only = hit.isNotNull() & F.forall(rest, lambda t: t.rlike(r"^\d+$"))
        out = F.when(only, F.array_join(F.concat(F.array(hit), rest), " ")).otherwise(out)
    return out
