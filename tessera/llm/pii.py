"""Personal data: keyed surrogates of the same type, format, script and gender.

Every surrogate is the image of its entity under a keyed permutation of all values of the same shape, so distinct entities
of a type never meet in one surrogate, the same entity has the same surrogate in every document, and no task needs to know
any other entity. The permutation is a Feistel network P conjugated with a shift, P^-1(P(x) + s): one cycle without fixed
points, so no entity is its own surrogate. Names are respelled sound by sound, so a part of a name has the same surrogate
alone as within the whole name, and later mentions of a person in a document follow the first. ``checked`` tests the
outcome over a whole corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import marked, written

# Given names by script and gender. Entities from a list get surrogates from the same list.
GIVEN = {
    ("latin", "f"): "Alice Amelie Andrea Angela Anna Anne Barbara Beatriz Brigitte Camille Carla Carmen Catherine Charlotte Chloe Claire Claudia Cristina Diana Elena Elizabeth Ella Emily Emma Eva Fiona Greta Hanna Hannah Heike Helen Helena Ines Irene Isabel Jennifer Jessica Julia Julie Karin Katharina Laura Lena Linda Lisa Louise Lucia Manon Margaret Maria Marie Marta Mary Monika Nathalie Nicole Nina Nora Olga Olivia Patricia Paula Petra Pilar Rosa Sabine Sandra Sara Sarah Sofia Sophie Stefanie Susan Teresa Ursula Valerie Vera Yvonne".split(),
    ("latin", "m"): "Adam Alan Alejandro Alexander Andreas Andrew Anthony Antoine Anton Antonio Bernd Brian Bruno Carlos Charles Christopher Daniel David Diego Edward Enrique Erik Felix Fernando Francisco Franz Frederic Georg George Gerhard Guillaume Hans Heinrich Henri Hugo Ivan Jacques Jakob James Jan Javier Jean John Jonas Jorge Jose Joseph Juan Juergen Julien Karl Kevin Klaus Laurent Leon Louis Lucas Luis Lukas Manuel Marco Martin Matthew Max Michael Miguel Nicolas Olivier Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Rolf Sergio Simon Stefan Stephen Thomas Uwe Viktor Walter William Wolfgang".split(),
    ("cyrillic", "f"): "Алина Анна Вера Дарья Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Иван Михаил Олег Павел Сергей Юрий".split(),
}
# Sounds that stand for one another in a name: runs of consonants at its beginning, within it, at its end, and of vowels.
ONSETS = "schl schm schn schr schw scr spr str bl br ch cl cr dr fl fr gl gr kl kr pl pr sc sch sh sk sl sm sn sp st sw th tr tw wh".split()
MIDDLES = "bb bl br ch ck ct dd dr ff ft gg gr ld ll lm ln ls lt lv mb mm mp nd ng nk nn nr ns nt pp pr rb rd rg rk rl rm rn rr rs rt rv sh sk sp ss st th tr tt ndr ntr rst str tch lsk nsk wsk rsk".split()
CODAS = "ch ck ft ld lf ll lm ln ls lt mp nd ng nk nn ns nt rd rf rg rk rl rm rn rr rs rt sh sk ss st th ts tt tz cht nst rst rth tch lsk nsk wsk rsk".split()
DIPHTHONGS = "ai au ea ee ei eu ia ie io oa oo ou ue ui".split()
_LISTS = {name: (key, names) for key, names in GIVEN.items() for name in names}
_FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа"}
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞЁА-Я", "a-zß-öø-ÿа-яё"
_NAME = rf"[{_UPPER}][{_LOWER}]+(?:[-'’][{_UPPER}][{_LOWER}]+)*|O['’][{_UPPER}][{_LOWER}]+"
_GIVEN = "|".join(sorted(_LISTS))
_TITLE = "Mrs?|Ms|Miss|Herr|Frau|Señora?|Monsieur|Madame|Mme|г-н|г-жа"
_NEXT = rf"(?: (?!(?:{_TITLE})\b)(?:{_NAME}))"

#: What a text must hold for any entity to be possible, secrets of letters alone too; RE2, so linear and fast. Digits of all
#: scripts and the letters that ``re`` takes for i without case count, as they do in PATTERNS.
HINT = r"[\p{Nd}@]|(?i:token|secret|passwd|password|ap[iİı][_-]?key|access[_-]?key)|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme)\b|г-н|г-жа|(?:" + _GIVEN + rf") [{_UPPER}]"

PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_-]{16,})"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\d+])(?<!\d[ -])\d{4}(?:[ -]?\d{4}){3}(?![ -]?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
              r"|(?<![\w+.-])[2-9]\d{2}([.-])\d{3}\g<-1>\d{4}(?![\w-])|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w+.-])0\d{2,4}[/-]\d{5,8}(?![\w-])".replace(r"([.-])", r"(?P<sep>[.-])").replace(r"\g<-1>", r"(?P=sep)")),
    ("name", rf"\b(?P<title>{_TITLE})\b\.? +(?P<name>(?!(?:{_TITLE})\b)(?:{_NAME}){_NEXT}{{0,2}})"),
    ("person", rf"\b(?P<person>(?:{_GIVEN})(?:-(?:{_GIVEN}))?(?: [{_UPPER}]\.)?{_NEXT}{{1,2}})(?!\w)"),
]
TYPES = [t for t, _ in PATTERNS if t != "person"]
_KINDS = [t for t, _ in PATTERNS]
_FIND = re.compile("|".join(f"(?P<t_{t}>{p})" for t, p in PATTERNS))
_WORD = re.compile(rf"(?<!\w)(?:{_NAME})(?!\w)")

_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_LETTERS = ["bcdfghjklmnpqrstvwxz", "aeiou", "y", "àáâäåæèéêëìíîïòóôöøùúûü", "çñšžß", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь"]
_HEX = ["0123456789abcdef"]


def _round(key: bytes, tweak: str, i: int, half: int, bits: int) -> int:
    size = -(-bits // 8)
    out = b""
    while len(out) < size:
        out += hashlib.blake2b(b"%d|%d|%d|%d" % (i, half, bits, len(out)), key=hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest(), digest_size=min(64, size)).digest()
    return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)


def _feistel(x: int, bits: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of [0, 2^(2 * bits)) in ten rounds, and its inverse."""
    left, right = x >> bits, x & ((1 << bits) - 1)
    for i in reversed(range(10)) if back else range(10):
        if back:
            left, right = right ^ _round(key, tweak, i, left, bits), left
        else:
            left, right = right, left ^ _round(key, tweak, i, right, bits)
    return left << bits | right


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """The image of x under a keyed permutation of [0, size) that is one cycle: no fixed point if size is 2 or more."""
    if size < 2:
        return x
    bits = max(1, -(-(size - 1).bit_length() // 2))
    shift = 1 + _round(key, tweak, 99, 0, 64) % (size - 1)
    y = _feistel(x, bits, key, tweak)
    while y >= size:  # walk the cycle back into the domain
        y = _feistel(y, bits, key, tweak)
    y = (y + shift) % size
    y = _feistel(y, bits, key, tweak, back=True)
    while y >= size:
        y = _feistel(y, bits, key, tweak, back=True)
    return y


def _respelled(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """``text`` with the characters of each alphabet permuted together; other characters stay where they are."""
    size, value, places = 1, 0, []
    for i, ch in enumerate(text):
        for letters in alphabets:
            if (at := letters.find(ch)) >= 0:
                places.append((i, letters))
                value = value * len(letters) + at
                size *= len(letters)
                break
    shape = "".join(str(alphabets.index(a)) for _, a in places) + "|" + "".join(c if all(c not in a for a in alphabets) else "." for c in text)
    value = permute(value, size, key, f"{tweak}|{shape}")
    out = list(text)
    for i, letters in reversed(places):
        value, at = divmod(value, len(letters))
        out[i] = letters[at]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _laid_out(form: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def _email(value: str, key: bytes) -> str:
    local, _, domain = value.lower().rpartition("@")
    labels = domain.split(".")
    fixed = 2 if labels[-2:] and labels[-2] == "example" else 1  # reserved names stay reserved
    own, rest = ".".join(labels[:-fixed]), ".".join(labels[-fixed:])
    new = _respelled(f"{local}@{own}" if own else local, _ALPHABETS, key, f"email|{rest}")
    return f"{new}.{rest}" if own else f"{new}@{rest}"


def _phone(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    code = re.match(r"\+(\d{1,3})[ .(-]", value)
    head = code[1] if code else digits[:1]
    tail = digits[len(head) :]
    return _laid_out(value, head + _digits(tail, key, f"phone|{head}|{value[0] == '+'}"))


def _check_digits(bban: str, country: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country) + "00") % 97


def _iban(value: str, key: bytes) -> str:
    """Country kept, account permuted, check digits valid if they were."""
    whole = value.replace(" ", "")
    country, check, bban = whole[:2], int(whole[2:4]), whole[4:]
    new = _respelled(bban, _ALPHABETS[:3], key, f"iban|{country}")
    if 2 <= check <= 98:
        off = (check - _check_digits(bban, country)) % 97  # 0: valid
        check = (_check_digits(new, country) + off - 2) % 97 + 2
    left = iter(f"{country}{check:02}{new}")
    return "".join(c if c == " " else next(left) for c in value)


def _digits(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}|{len(digits)}")).zfill(len(digits)) if digits else ""


def _card(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    off = (int(digits[-1]) - luhn(digits[:-1])) % 10  # 0: the number is valid, and so is its surrogate
    body = digits[0] + _digits(digits[1:-1], key, f"card|{digits[0]}|{off}")
    return _laid_out(value, body + str((luhn(body) + off) % 10))


def _ip(value: str, key: bytes) -> str:
    a, b, c, d = map(int, value.split("."))
    for head, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)):
        x = a << 24 | b << 16 | c << 8 | d
        if x >> bits == head >> bits:
            x = head | permute(x & ((1 << bits) - 1), 1 << bits, key, f"ip|{head}")
            break
    else:
        special = lambda n: n >> 24 in (10, 127) or n >> 20 == 172 << 4 | 1 or n >> 16 == 192 << 8 | 168
        x = permute(x, 1 << 32, key, "ip")
        while special(x):
            x = permute(x, 1 << 32, key, "ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _secret(value: str, key: bytes) -> str:
    return _respelled(value, _HEX if re.fullmatch(r"[0-9a-f]+", value) else _ALPHABETS[:3], key, "secret")


def _sounds(word: str, gender: str) -> list[tuple[str, list[str]]]:
    """The runs of a lower-case word, each with the sounds that may stand for it; a run that no table has goes letter by letter."""
    out: list[tuple[str, list[str]]] = []
    runs = re.findall(r"[bcdfghjklmnpqrstvwxz]+|[aeiou]+|.", word)
    for k, run in enumerate(runs):
        first, last = k == 0, k == len(runs) - 1
        if len(run) > 1 and run[0] in _LETTERS[0]:
            table = [x for x in (ONSETS if first else CODAS if last else MIDDLES) if len(x) == len(run)]
        elif len(run) > 1:
            table = DIPHTHONGS
        elif last and not first and run in "aeiou":  # the ending that tells a gender stays of its kind
            table = list("aei") if run in "aei" else list("ou")
        else:
            table = []
        if run in table:
            out.append((run, table))
        else:
            out += [(c, next((list(a) for a in _LETTERS if c in a), [c])) for c in run]
    return out


def _renamed(part: str, key: bytes, tweak: str) -> str:
    """A name's part respelled by sounds; capitals and joints stay where they are."""
    out = []
    for word in re.split(r"([-'’])", part):
        units = _sounds(word.lower(), "")
        size, value = 1, 0
        for unit, table in units:
            value, size = value * len(table) + table.index(unit), size * len(table)
        shape = "|".join("".join(t) for _, t in units)
        while True:  # runs that no table has must stay so, or two shapes would meet
            value = permute(value, size, key, f"{tweak}|{shape}")
            rest, made = value, []
            for _, table in reversed(units):
                rest, at = divmod(rest, len(table))
                made.append(table[at])
            new = "".join(reversed(made))
            if size < 2 or [t for _, t in _sounds(new, "")] == [t for _, t in units]:
                break
        out.append(new[:1].upper() + new[1:] if word[:1].isupper() else new)
    return "".join(out)


@lru_cache(100_000)
def name_part(part: str, role: str, gender: str, key: bytes) -> str:
    """The surrogate of one part of a name. A listed given name gets another one of its list, any other keeps its shape."""
    if re.fullmatch(rf"[{_UPPER}]\.", part):
        return _respelled(part, _ALPHABETS[2:5:2], key, "initial")
    if role == "given":
        if part in _LISTS:
            kind, names = _LISTS[part]
            return names[permute(names.index(part), len(names), key, f"given|{kind}")]
        if "-" in part and all(p in _LISTS for p in part.split("-")):
            return "-".join(name_part(p, role, gender, key) for p in part.split("-"))
        new = _renamed(part, key, f"given|{gender}")
        while new in _LISTS:  # a listed name belongs to the list's own permutation
            new = _renamed(new, key, f"given|{gender}")
        return new
    return _renamed(part, key, "surname")


def roles(name: str) -> list[tuple[str, str]]:
    """(part, role) of a name: the last part is the surname, unless a given name stands alone."""
    parts = name.split(" ")
    return [(p, "surname" if k == len(parts) - 1 and not (k == 0 and p in _LISTS) else "given") for k, p in enumerate(parts)]


def _person(name: str, gender: str, key: bytes) -> str:
    return " ".join(name_part(p, role, gender, key) for p, role in roles(name))


_MAKE: dict[str, Callable[[str, bytes], str]] = {
    "email": _email, "secret": _secret, "ip": _ip, "card": _card, "phone": _phone,
    "ssn": lambda v, k: _laid_out(v, _digits(re.sub(r"\D", "", v), k, "ssn")),
    "iban": _iban,
}


@lru_cache(100_000)
def surrogate(kind: str, value: str, gender: str, key: bytes) -> str:
    """The surrogate of one entity; ``kind`` may be ``given`` or ``surname`` for a part of a name alone."""
    if kind in ("given", "surname"):
        return name_part(value, kind, gender, key)
    return _person(value, gender, key) if kind == "name" else _MAKE[kind](value, key)


def entities(text: str) -> list[tuple[str, int, int, str, str]]:
    """(type, start, end, value, gender) of the entities of a text, left to right.

    A person is named by a title or by a listed given name. Wherever a part of that name stands again in the text, it is an
    entity of type ``given`` or ``surname``.
    """
    out, given, surnames = [], {}, set()
    for m in _FIND.finditer(text):
        kind = next(t for t in _KINDS if m[f"t_{t}"] is not None)
        group = kind if kind in ("secret", "name", "person") else 0
        gender = ""
        if kind in ("name", "person"):
            value = m[group]
            listed = _LISTS.get(re.split("[ -]", value)[0])
            gender = ("f" if m["title"] in _FEMALE else "m") if kind == "name" else listed[0][1]
            kind = "name"
            for part, role in roles(value):
                if role == "surname":
                    surnames.add(part)
                elif not part.endswith("."):
                    given.setdefault(part, gender)
        out.append((kind, m.start(group), m.end(group), m[group], gender))
    if given or surnames:
        taken, k, again = sorted((a, b) for _, a, b, _, _ in out), 0, []
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        for i, (a, b, word) in enumerate(words):
            if word not in given and word not in surnames:
                continue
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k < len(taken) and taken[k][0] < b:
                continue
            before_surname = i + 1 < len(words) and words[i + 1][0] == b + 1 and words[i + 1][2] in surnames
            role = "given" if word in given and (before_surname or word not in surnames) else "surname"
            again.append((role, a, b, word, given[word] if role == "given" else ""))
        out = sorted(out + again, key=lambda e: e[1])
    return out


def canonical(kind: str, value: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    return value.lower() if kind == "email" else value.replace(" ", "") if kind == "iban" else value


def digest(kind: str, form: str, key: bytes) -> str:
    """A keyed digest that stands for an entity."""
    return hashlib.blake2b(f"{kind}|{form}".encode(), key=key, digest_size=8).hexdigest()


def replaced(text: str, key: bytes) -> tuple[str, list[dict]]:
    """``text`` with surrogates, and the spans of both texts."""
    out, spans, at, grown = [], [], 0, 0
    for kind, a, b, value, gender in entities(text):
        new = surrogate(kind, value, gender, key)
        if kind == "name" and len(own := roles(value)) == 1:
            kind = own[0][1]  # the same as that part of a longer name
        out += [text[at:a], new]
        form = canonical(kind, new)
        tag = f"{kind}-{gender}" if kind in ("name", "given") else kind  # names of two genders are spelled apart
        spans.append({"type": kind if kind not in ("given", "surname") else "name", "start": a, "stop": b, "new_start": a + grown, "surrogate": new, "entity": digest(tag, canonical(kind, value), key), "form": f"{tag}:{form}" if kind in ("name", "given", "surname") else form, "echo": digest(tag, form, key)})
        grown += len(new) - (b - a)
        at = b
    out.append(text[at:])
    return "".join(out), spans


SPANS = "array<struct<type:string,start:int,stop:int,new_start:int,surrogate:string,entity:string,form:string,echo:string>>"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and their spans in ``pii``.

    ``pii.entity`` is a keyed digest of the original, never the original itself; ``form`` is what spellings of a surrogate
    share, and ``echo`` the digest that the surrogate would have as an original. One pass without a shuffle: a row's result
    depends on its text and the key alone. Null texts stay null with null ``pii``; texts without entities are unchanged with
    an empty ``pii``; repeated rows get equal results; of patterns that fit at one place the first of PATTERNS wins. A text
    of any length is held whole by one task. A column named ``pii`` is replaced; an empty table stays empty.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    cols = [c for c in docs.columns if c.lower() != "pii"]
    df = docs.select(*[f"`{c}`" for c in cols])
    place, secret = cols.index(text_col), key.encode()[:64]
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("new_start", pa.int32()), ("surrogate", pa.string()), ("entity", pa.string()), ("form", pa.string()), ("echo", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            hint = pc.match_substring_regex(texts, HINT)
            new: list = [None] * len(texts)
            spans: list = [[] for _ in range(len(texts))]
            for i in pc.indices_nonzero(pc.fill_null(hint, False)).to_pylist():
                new[i], spans[i] = replaced(texts[i].as_py(), secret)
            made = pa.array(new, texts.type)
            texts = pc.if_else(made.is_valid(), made, texts)
            spans = [None if hint[i].as_py() is None else s for i, s in enumerate(spans)] if texts.null_count else spans
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*cols, "pii"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, pii {SPANS}")


def _spans(done: DataFrame) -> DataFrame:
    return done.select(F.explode("pii").alias("p")).select("p.type", "p.form", "p.entity", "p.echo").distinct()


def collisions(done: DataFrame) -> DataFrame:
    """(type, form, n) of surrogates that stand for more than one entity; empty if distinctness holds."""
    return _spans(done).groupBy("type", "form").agg(F.countDistinct("entity").alias("n")).where("n > 1")


def torn(done: DataFrame) -> DataFrame:
    """(type, entity, n) of entities with more than one surrogate; empty if coreference holds."""
    return _spans(done).groupBy("type", "entity").agg(F.countDistinct("form").alias("n")).where("n > 1")


def echoes(done: DataFrame) -> DataFrame:
    """(type, form) of surrogates that some document's original spells alike. Parts of names are left out: they come from lists."""
    whole = _spans(done).where("type <> 'name' or form like '% %'")
    return whole.select("type", "form", F.col("echo").alias("entity")).join(whole.select("type", "entity").distinct(), ["type", "entity"], "left_semi").select("type", "form").distinct()


def checked(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``done`` with ``pii_checks``: which checks some surrogate of the row's id fails (``collision``, ``torn``, ``echo``).

    Only spans are shuffled, each distinct one once; rows without an id are not checked. ``done`` is read twice, so a
    written table serves best.
    """
    bad = collisions(done).select("type", F.lit("collision").alias("check"), "form", F.lit(None).cast("string").alias("entity"))
    bad = bad.unionByName(echoes(done).select("type", F.lit("echo").alias("check"), "form", F.lit(None).cast("string").alias("entity")))
    bad = bad.unionByName(torn(done).select("type", F.lit("torn").alias("check"), F.lit(None).cast("string").alias("form"), "entity"))
    spans = done.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id__"), F.explode("pii").alias("p")).select("id__", "p.type", "p.form", "p.entity")
    by_form = spans.join(bad.where("form is not null").select("type", "form", "check"), ["type", "form"]).select("id__", "check")
    by_entity = spans.join(bad.where("entity is not null").select("type", "entity", "check"), ["type", "entity"]).select("id__", "check")
    found = by_form.unionByName(by_entity).groupBy("id__").agg(F.array_sort(F.collect_set("check")).alias("pii_checks"))
    found, _ = written(found, "pii-checks")
    # texts of rows that cannot be listed are not shuffled
    rest = marked(done.drop("pii_checks"), id_col, found.select("id__"), "maybe__")
    none = F.array().cast("array<string>")
    some = rest.where("maybe__").join(found, F.col(f"`{id_col}`") == F.col("id__"), "left").drop("id__", "maybe__").withColumn("pii_checks", F.coalesce("pii_checks", none))
    return rest.where("not maybe__").drop("maybe__").withColumn("pii_checks", none).unionByName(some)
