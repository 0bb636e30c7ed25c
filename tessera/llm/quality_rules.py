"""Quality rules, line first: failing lines go, then documents that lose too much text or fail the base counts.

Built-in functions only and no shuffle: every rule is an expression over one row. Repeated word windows are found by
sorting (window hash, position) pairs inside the row, so a text of n words costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document verdict."""

    #: A line fails if more than this share of its words is separators such as ``|``.
    separator_share: float = 0.2
    #: ... or carries runs of symbols (``###``, ``$$$``, ...).
    symbol_share: float = 0.2
    #: ... or ends with ``!``.
    shout_share: float = 0.3
    #: ... or lacks terminal punctuation while having at least this many words (a long run-on list).
    unpunctuated_words: int = 60
    #: ... or is a menu: four words or more, up to twelve, all of them with a capital and none with punctuation.
    menu: str = r"^(?:\p{Lu}[^ \t.!?…:;,]*[ \t]+){3,11}\p{Lu}[^ \t.!?…:;,]*$"
    #: Boilerplate phrases in the corpus's languages; a line of at most ``boilerplate_words`` words that has one fails.
    boilerplate: str = (
        r"(?i)^impressum$|(?:^|[^a-zA-Z])(?:"  # only where a word begins, which most places of a line are not
        r"enable javascript|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|sign in to|click here|subscribe to our"
        r"|skip to (?:main )?content|share (?:this )?on|follow us on|read more$|back to top|add to cart"
        r"|cookies akzeptieren|datenschutzerkl[äÄ]rung|alle rechte vorbehalten|nutzungsbedingungen|newsletter abonnieren|hier klicken|zum inhalt springen"
        r"|accepter les cookies|politique de confidentialit[éÉ]|mentions l[éÉ]gales|tous droits r[éÉ]serv[éÉ]s|conditions d.utilisation|cliquez ici|abonnez.vous|aller au contenu"
        r"|aceptar (?:las |todas las )?cookies|pol[íÍ]tica de privacidad|aviso legal|todos los derechos reservados|condiciones de uso|haga clic aqu[íÍ]|suscr[íÍ]base|ir al contenido)"
    )
    boilerplate_words: int = 30
    #: A document goes if its failing lines hold more than this share of its words.
    max_lost_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that ``_trimmed`` has trimmed."""
    return F.when(F.length(text) > 0, F.split(text, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, n_bad_words, base_failed,
    cleaned, kept``.

    ``n_repeat_words`` counts the words that stand in a 3-word window which occurs twice or more in the text, its first
    occurrence included. ``cleaned`` is the text without failing lines. A null or empty text has no words, so its base
    fails. Repeated rows are judged alike; columns of ``docs`` named as a result column are replaced; an empty table stays
    empty. A text of any length is judged whole, by one task.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_bad_words", "base_failed", "cleaned", "kept"]
    kept_cols = [c for c in docs.columns if c.lower() not in made]
    own = [F.col("__own")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_cols]).alias("__own"), text.alias("__t"))
    df = df.withColumn("__w", words_of(_trimmed(F.col("__t"))))
    df = df.withColumn("__n", F.size("__w")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("__h", F.when(F.col("__n") >= 3, F.expr("transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2]))"))).drop("__w")
    # (hash, position) of each 3-word window, equal windows side by side, if any are equal
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.expr("sort_array(transform(__h, (h, i) -> struct(h as h, i as i)))"))).drop("__h")
    twice = F.expr("sort_array(transform(filter(__s, (x, j) -> (j > 0 and __s[greatest(j - 1, 0)].h = x.h) or (j + 1 < __n - 2 and __s[least(j + 1, __n - 3)].h = x.h)), x -> x.i))")
    df = df.withColumn("__p", twice).drop("__s")
    covered = F.expr("aggregate(__p, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")

    df = df.withColumn("__lines", F.split("__t", "\n", -1))
    df = df.withColumn("__full", F.filter("__lines", lambda x: x.rlike(r"[^ \t-\r]")))

    # one step each, so that a line is trimmed and its words are counted once, however many rules ask
    bare = F.transform("__full", lambda x: F.struct(x.alias("line"), _trimmed(x).alias("bare")))
    sized = F.transform(bare, lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), (F.regexp_count(x["bare"], F.lit(r"[ \t-\r]+")) + 1).alias("n")))
    df = df.withColumn("__f", F.transform(sized, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), _bad(x["bare"], x["n"], rules).alias("bad"))))
    df = df.select(
        *own, "__t", "n_repeat_words",
        F.col("__n").cast("long").alias("n_words"),
        "word_chars",
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__f", lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        F.aggregate(F.filter("__f", lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_bad_words"),
        F.array_join(F.transform(F.filter("__f", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    keep = ~F.col("base_failed") & (F.col("n_bad_words") <= rules.max_lost_share * F.col("n_words"))
    # a generator keeps later filters on the verdict from being pushed down, which would repeat the rules inside themselves
    done = df.withColumn("kept", keep).select(*own, F.inline(F.array(F.struct(*made))))
    return done.select(*[F.col("__own")[c].alias(c) for c in kept_cols], *made)


def _bad(line: Column, n: Column, rules: LineRules) -> Column:
    """Whether a trimmed line of n words fails a rule."""
    marked = line.rlike(r"[|»›•·>/#*$%&!]")  # most lines have none of these and need no counting
    navigation = F.regexp_count(line, F.lit(r"[|»›•·>/](?!\S)(?<!\S.)")) > rules.separator_share * n
    symbols = F.regexp_count(line, F.lit(r"[#*$%&]{2,}")) > rules.symbol_share * n
    shouting = F.regexp_count(line, F.lit(r"!(?!\S)")) > rules.shout_share * n
    runon = (n >= rules.unpunctuated_words) & ~line.rlike(r"[.!?…:;,\"'”’»)\]]$")
    menu = (n >= 4) & (n <= 12) & line.rlike(rules.menu)
    boilerplate = (n <= rules.boilerplate_words) & line.rlike(rules.boilerplate)
    return F.when(marked, navigation | symbols | shouting).otherwise(False) | runon | menu | boilerplate
