"""Script normalisation that Spark has no built-in for, as Arrow UDFs over whole batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.operators import lexicon as lex

_FOLD = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng", "’": "'", "‘": "'", "–": "-", "—": "-"})
_VOWELS = dict(zip("अआइईउऊएऐओऔऑऋ", "a aa i ii u uu e ai o au o ri".split(), strict=True))
_SIGNS = dict(zip("ािीुूेैोौॉृ", "aa i ii u uu e ai o au o ri".split(), strict=True))
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n p ph b bh m y r l v sh ss s h".split(), strict=True))
_VIRAMA, _NASALS = "्", "ंँ"
_UNSEEN, _DEVA = re.compile("[​‌‍⁠﻿­]"), re.compile("[ऀ-ॿ]+")
#: Bytes of words as they are, any other as a blank.
_KEPT = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))
_BEYOND, _NON_ASCII = re.compile("[^\x00-ʯ]"), re.compile("[^\x00-\x7f]")
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўђјљњћџ", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch _ y _ e iu ia i i ie g u dj j lj nj c dz".split(), strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_BY_LETTER = {c: "" if t == "_" else t for table in (_CYRILLIC, _GREEK) for c, t in table.items()}
#: Starts of the blocks that Unicode lays out like Devanagari: Bengali, Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada, Malayalam.
_INDIC = range(0x0980, 0x0D80, 0x80)
_DIGRAPHS = ("SH", "CH", "KH", "GH", "TH", "DH", "PH", "TS", "ZH")


_KNOWN_DEVA = frozenset([*_VOWELS, *_SIGNS, *_CONSONANTS, *_NASALS, *"ः़्"])


def _plain_deva(ch: str) -> str:
    return _VOWELS.get(ch) or _SIGNS.get(ch) or _CONSONANTS.get(ch) or ("n" if ch in _NASALS else "h" if ch == "ः" else "" if ch in "़्" else ch)


@lru_cache(65_536)
def _letter(ch: str) -> str:
    """A character of another script in Latin letters, by its script's layout or its Unicode name."""
    if ch.isdecimal():
        return str(unicodedata.decimal(ch))
    if "ऀ" <= ch <= "ॿ":
        return _plain_deva(ch)
    if ch in _BY_LETTER:
        return _BY_LETTER[ch]
    if any(start <= ord(ch) < start + 0x80 for start in _INDIC) and (alike := chr(0x0900 + ord(ch) % 0x80)) in _KNOWN_DEVA:
        return _plain_deva(alike)
    if unicodedata.category(ch)[0] != "L":
        return ch
    name = unicodedata.name(ch, "")
    if name.startswith(("HIRAGANA LETTER", "KATAKANA LETTER", "HANGUL SYLLABLE")):
        return name.split()[-1].lower()
    if name.startswith("CJK UNIFIED IDEOGRAPH"):  # no rule gives a reading, so the code point stands for it
        return f" u{ord(ch):x} "
    base = unicodedata.normalize("NFKD", ch)[0]
    if base != ch:
        return _letter(base)
    sound = re.split(" LETTER | CHARACTER ", name)[-1].removeprefix("FINAL ").split(" ")[0] if name else ""
    return sound[:2].lower() if sound[:2] in _DIGRAPHS else sound[:1].lower()


@lru_cache(65_536)
def _plain(ch: str) -> str:
    """A lower-case character that is not ASCII in Latin letters; empty for a mark on another one."""
    text = unicodedata.normalize("NFKD", _BEYOND.sub(lambda m: _letter(m[0]), ch.translate(_FOLD)))
    return _NON_ASCII.sub(lambda m: "" if unicodedata.combining(m[0]) else _letter(m[0]), text)


@lru_cache(65_536)
def deva_word(word: str) -> str:
    """A Devanagari word by sound: inherent vowels written, final ones dropped, length and place of sounds folded."""
    out, bare = "", False
    for ch in word:
        if ch in _CONSONANTS:
            out += ("a" if bare else "") + _CONSONANTS[ch]
            bare = True
        elif ch in _SIGNS:
            out, bare = out + _SIGNS[ch], False
        elif ch == _VIRAMA:
            bare = False
        elif ch in _VOWELS or ch in _NASALS or ch == "ः":
            out += ("a" if bare else "") + _plain_deva(ch)
            bare = False
        elif ch != "़":
            out += ("a" if bare else "") + (str(unicodedata.decimal(ch)) if ch.isdecimal() else ch)
            bare = False
    if bare and len(word) > 1 and word[-2] == _VIRAMA:
        out += "a"
    for a, b in (("aa", "a"), ("ii", "i"), ("uu", "u"), ("tth", "th"), ("ddh", "dh"), ("tt", "t"), ("dd", "d"), ("nn", "n"), ("ss", "s"), ("ph", "f")):
        out = out.replace(a, b)
    return out


def latin(text: str, by_sound: bool = False) -> str:
    """Lower-case a-z and 0-9 words of a text in any script.

    Letters beyond Latin go by rule: the layout of their block, their table, or their Unicode name; digits by their value.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
        if by_sound:
            text = _DEVA.sub(lambda m: deva_word(m[0]), text)
        text = text.lower()
        kinds = set(_NON_ASCII.findall(text))
        if len(kinds) > 64:
            text = _NON_ASCII.sub(lambda m: _plain(m[0]), text)
        else:  # what stands for a character is ASCII or itself, so one replacement does not undo another
            for ch in kinds:
                text = text.replace(ch, _plain(ch))
    return b" ".join(text.lower().replace("&", " and ").encode("ascii", "replace").translate(_KEPT).split()).decode()


def light(text: str) -> str:
    """Original script: joiners kept, composed, case folded, blanks squeezed."""
    return " ".join(unicodedata.normalize("NFC", re.sub("[​⁠﻿­]", "", text)).casefold().split())


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252, read again; unchanged where that fails."""
    if not re.search(lex.MOJIBAKE, text):
        return text
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text


@F.pandas_udf(StringType())
def to_latin(s: pd.Series) -> pd.Series:
    return s.map(latin, na_action="ignore")


@F.pandas_udf(StringType())
def to_latin_by_sound(s: pd.Series) -> pd.Series:
    return s.map(lambda x: latin(x, True), na_action="ignore")


def _components(text: str, by_sound: bool) -> list[str]:
    return [p for p in (latin(part, by_sound) for part in text.split(",")) if p]


@F.pandas_udf(ArrayType(StringType()))
def latin_components(s: pd.Series) -> pd.Series:
    """The parts of a text between commas in Latin letters, without empty ones."""
    return s.map(lambda x: _components(x, False), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def latin_components_by_sound(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _components(x, True), na_action="ignore")


@F.pandas_udf(StringType())
def to_light(s: pd.Series) -> pd.Series:
    return s.map(light, na_action="ignore")


@F.pandas_udf(StringType())
def repair(s: pd.Series) -> pd.Series:
    return s.map(repaired, na_action="ignore")
