"""License scans: sentences of a text become known identifiers; ordered rules turn their sequence into licences.

Sentences are split and normalised (case, punctuation, blanks, comment marks and line breaks), looked up in the sentence
table, and the document's identifier sequence is matched against the rules in order; a rule consumes the identifiers that it
matched. A sentence may be wrapped over the lines of a paragraph: a line that may begin a known sentence is read on for as
long as the table allows it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import regex as re
from pyspark.sql import DataFrame

#: What a text must hold for any sentence of the table, or any unknown one: between words may stand whatever ``normalise``
#: turns into a blank. RE2 and ``regex`` read it alike, up to \W, where RE2 finds more.
HINT = r"(?i)licen[sc]|copyright|\(c\)|©|warrant|permission|redistribut|spdx|rights[\W_]+reserved|later[\W_]+version|public[\W_]+domain|as[\W_]+is|endorse|liab|misrepresent|acknowledg|jurisdiction|obtain|unencumbered|do[\W_]+what[\W_]+the|free[\W_]+to[\W_]+copy|source[\W_]+distribution"

# Sentences of published licences and of the notices that they ask for, normalised, as patterns over the whole
# sentence. A group named v gives the identifier's version.
_WHAT = r"(?:this |the )?(?:program|software|library|file|work|code|project|package|product|source code form|repository)"
_GPL = r"gnu {} ?(?:public|general public) licen[sc]e"
_GNU = r"you can redistribute it and or modify it under the terms of (?:version (?P<v>\d(?:\.\d)?) of )?the {}(?: version (?P<v>\d(?:\.\d)?))?(?: as published by the free software foundation)?(?: either)?(?: version (?P<v>\d(?:\.\d)?))?(?: of the licen[sc]e)?"
_LATER = r"(?: or (?:at your option )?any later version| or later)"
_UNDER = r"(?:" + _WHAT + r" (?:is|are) )?(?:(?:released|licen[sc]ed|distributed|made available|available|provided|published) )+(?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_GRANTS = {"General": r"gnu general public licen[sc]e", "Lesser": r"gnu (?:lesser|library) general public licen[sc]e", "Affero": r"gnu affero general public licen[sc]e"}
_SHORT = {"General": "Gpl", "Lesser": "Lgpl", "Affero": "Agpl"}
_ITEM = r"(?:(?:\d|[a-z]) )?"
_FEW, _SOME = r"(?:\S+ ){1,8}", r"(?:\S+ ){1,40}"  # words that a notice names its own holders by
SENTENCES: list[tuple[str, str]] = [
    ("Spdx", r"(?:.*\b)?spdx license identifier (?P<v>[a-z0-9.+-]+)(?: .*)?"),
    ("Copyright", r"(?:portions |parts )?(?:copyright|c copyright|©) .*"),
    ("AllRights", r"all rights reserved"),
    # MIT, ISC and Zlib
    ("MitTitle", r"(?:the )?mit licen[sc]e(?: mit)?"),
    ("MitRef", _UNDER + r"mit licen[sc]e.*"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("MitNotice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("MitLiability", r"in no event shall the (?:" + _FEW + r")?authors or copyright holders be liable for any claim damages or other liability.*"),
    ("IscTitle", r"(?:the )?isc licen[sc]e(?: isc)?"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties with regard to this software.*"),
    ("IscLiability", r"in no event shall the author be liable for any special direct indirect or consequential damages.*"),
    ("ZlibTitle", r"(?:the )?zlib licen[sc]e"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibLiability", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZlibOrigin", _ITEM + r"the origin of this software must not be misrepresented.*"),
    ("ZlibCredit", r"if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("ZlibAltered", _ITEM + r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("ZlibNotice", _ITEM + r"this notice may not be removed or altered from any source distribution"),
    # BSD
    ("BsdTitle", r"(?:the )?(?:new |simplified |modified )?bsd (?P<v>[23]) clause licen[sc]e"),
    ("BsdRef", _UNDER + r"(?:new |simplified |modified )?(?:bsd (?P<v>[23]) clause|(?P<v>[23]) clause bsd) licen[sc]e.*"),
    ("BsdUse", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", _ITEM + r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", _ITEM + r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdNames", _ITEM + r"neither the names? of " + _SOME + r"may be used to endorse or promote products derived from this software.*"),
    ("BsdAsIs", r"this software is provided by " + _SOME + r"as is and any express or implied warranties.*"),
    ("BsdLiability", r"in no event shall " + _SOME + r"be liable for any direct indirect incidental special exemplary or consequential damages.*"),
    # Apache
    ("ApacheTitle", r"apache licen[sc]e(?: version (?P<v>\d(?:\.\d)?)(?: january 2004.*)?)?"),
    ("ApacheRef", r"(?:" + _WHAT + r" is )?licen[sc]ed (?:to you )?under the apache licen[sc]e version (?P<v>\d(?:\.\d)?)(?: the licen[sc]e)?(?: you may not use this file except in compliance with the licen[sc]e)?"),
    ("ApacheRef", _UNDER + r"apache licen[sc]e version (?P<v>\d(?:\.\d)?).*"),
    ("ApacheGrant", r"the " + _FEW + r"licen[sc]es this file to you under the apache licen[sc]e version (?P<v>\d(?:\.\d)?)(?: the licen[sc]e)?(?: you may not use this file except in compliance with the licen[sc]e)?"),
    ("ApacheUse", r"you may not use this file except in compliance with the licen[sc]e"),
    ("ApacheCopy", r"you may obtain a copy of the licen[sc]e at.*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis.*"),
    ("ApacheSee", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("ApacheTeam", r"licen[sc]ed to the " + _FEW + r"under one or more contributor licen[sc]e agreements"),
    ("ApacheNotice", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    # GNU
    *[(f"{_SHORT[k]}LaterGrant", rf"{_WHAT} is free software {_GNU.format(g)}{_LATER}") for k, g in _GRANTS.items()],
    *[(f"{_SHORT[k]}Grant", rf"{_WHAT} is free software {_GNU.format(g)}(?: only)?") for k, g in _GRANTS.items()],
    *[(f"{_SHORT[k]}LaterRef", rf"(?:{_UNDER})?{'' if k == 'Lesser' else '(?:under the (?:terms of the )?)?'}{g}(?: as published by the free software foundation)?(?: either)? (?:version |v)(?P<v>\d(?:\.\d)?)(?: of the licen[sc]e)?{_LATER}") for k, g in _GRANTS.items()],
    *[(f"{_SHORT[k]}Ref", rf"(?:{_UNDER}|under the (?:terms of the )?)?{g}(?: as published by the free software foundation)?(?: either)? (?:version |v)(?P<v>\d(?:\.\d)?)(?: of the licen[sc]e)?(?: only)?(?: {{d}}.*)?".replace("{d}", r"\d+ \w+ \d{4}")) for k, g in _GRANTS.items()],
    ("OrLater", r"(?:or )?(?:at your option )?any later version"),
    ("GplNoWarranty", _WHAT + r" is distributed in the hope that it will be useful but without any warranty.*"),
    ("GnuSee", r"see the gnu (?:lesser |library |affero )?general public licen[sc]e for more details"),
    ("GnuCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e.*"),
    # others
    ("MplTitle", r"mozilla public licen[sc]e version (?P<v>\d\.\d)"),
    ("MplRef", r"this source code form is subject to the terms of the mozilla public licen[sc]e (?:v|version) (?P<v>\d\.\d)"),
    ("MplRef", _UNDER + r"mozilla public licen[sc]e (?:v|version) ?(?P<v>\d\.\d).*"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("EplRef", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?(?P<v>\d\.\d).*"),
    ("BslTitle", r"boost software licen[sc]e version (?P<v>\d\.\d).*"),
    ("BslRef", _UNDER + r"boost software licen[sc]e version (?P<v>\d\.\d).*"),
    ("BslGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e.*"),
    ("UnlicensePublic", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseGrant", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("UnlicenseLaws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate.*"),
    ("WtfplTitle", r"do what the fuck you want to public licen[sc]e.*"),
    ("WtfplGrant", _ITEM + r"(?:0 )?you just do what the fuck you want to"),
    ("CcZero", r"(?:.* )?(?:cc0 1\.0 universal|creative commons zero v?1\.0 universal|cc0 1\.0).*"),
    ("CcRef", _UNDER + r"(?:a |the )?(?:cc|creative commons) (?P<v>by(?: (?:nc|nd|sa))* \d\.\d)(?: .*)?"),
    ("CcNamed", _UNDER + r"(?:a |the )?creative commons attribution(?P<nc> non ?commercial)?(?P<nd> no ?deriv(?:ative)?s)?(?P<sa> share ?alike)? (?P<n>\d\.\d)(?: .*)?"),
    ("PublicDomain", r"this (?:work|software|file) is (?:released into|in) the public domain"),
    # disclaimers that several licences share
    ("AsIs", r"(?:the|this) software is provided (?:by " + _SOME + r")?as is.*"),
]


@dataclass(frozen=True)
class Rule:
    """``licence`` (with ``{v}`` for the version of the first identifier) if ``sequence`` occurs in order; ``?`` marks optional ones."""

    licence: str
    sequence: tuple[str, ...]


def _gnu(short: str, name: str) -> list[Rule]:
    rest = ("GplNoWarranty?", "GnuSee?", "GnuCopy?")
    return [Rule(f"{name}-{{v}}-or-later", (f"{short}LaterGrant", *rest)), Rule(f"{name}-{{v}}", (f"{short}Grant", *rest)), Rule(f"{name}-{{v}}-or-later", (f"{short}LaterRef", *rest)),
            Rule(f"{name}-{{v}}-or-later", (f"{short}Ref", "OrLater", *rest)), Rule(f"{name}-{{v}}", (f"{short}Ref", *rest))]


#: Ordered: longer and more specific rules first.
RULES: list[Rule] = [
    Rule("Apache-{v}", ("ApacheTeam?", "ApacheNotice?", "ApacheGrant", "ApacheUse?", "ApacheCopy?", "ApacheAsIs?", "ApacheSee?")),
    Rule("Apache-{v}", ("ApacheTitle?", "ApacheRef", "ApacheUse?", "ApacheCopy?", "ApacheAsIs?", "ApacheSee?")),
    Rule("MIT", ("MitTitle?", "MitRef?", "MitGrant", "MitNotice?", "AsIs?", "MitLiability?")),
    Rule("ISC", ("IscTitle?", "IscGrant", "IscAsIs?", "IscLiability?")),
    Rule("0BSD", ("ZeroGrant", "IscAsIs?", "IscLiability?")),
    Rule("Zlib", ("ZlibTitle?", "ZlibAsIs?", "ZlibLiability?", "ZlibGrant", "ZlibOrigin?", "ZlibCredit?", "ZlibAltered?", "ZlibNotice?")),
    Rule("BSD-3-Clause", ("BsdTitle?", "BsdUse", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs?", "AsIs?", "BsdLiability?")),
    Rule("BSD-2-Clause", ("BsdTitle?", "BsdUse", "BsdSource", "BsdBinary", "BsdAsIs?", "AsIs?", "BsdLiability?")),
    *_gnu("Agpl", "AGPL"), *_gnu("Lgpl", "LGPL"), *_gnu("Gpl", "GPL"),
    Rule("MPL-{v}", ("MplRef", "MplCopy?")), Rule("MPL-{v}", ("MplTitle",)), Rule("EPL-{v}", ("EplRef",)),
    Rule("BSL-{v}", ("BslTitle", "BslGrant?", "AsIs?")), Rule("BSL-1.0", ("BslGrant", "AsIs?")), Rule("BSL-{v}", ("BslRef",)),
    Rule("Unlicense", ("UnlicensePublic", "UnlicenseGrant?", "UnlicenseLaws?", "AsIs?", "MitLiability?")),
    Rule("WTFPL", ("WtfplTitle", "WtfplGrant?")),
    Rule("CC-{v}", ("CcRef",)), Rule("CC-{v}", ("CcNamed",)), Rule("CC0-1.0", ("CcZero",)),
    Rule("BSD-{v}-Clause", ("BsdRef",)), Rule("BSD-{v}-Clause", ("BsdTitle",)),
    Rule("MIT", ("MitRef",)), Rule("MIT", ("MitTitle",)), Rule("ISC", ("IscTitle",)), Rule("Zlib", ("ZlibTitle",)),
    Rule("Apache-{v}", ("ApacheTitle", "ApacheCopy?", "ApacheAsIs?")),
    Rule("{v}", ("Spdx",)),
    Rule("Public-Domain", ("PublicDomain",)),
    Rule("Proprietary", ("Copyright", "AllRights")),
]

_SENTENCE = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: Sentences that end with their line whatever follows.
_ONE_LINE = ("Copyright", "AllRights", "Spdx", "MitTitle", "IscTitle", "ZlibTitle", "BsdTitle", "ApacheTitle", "MplTitle", "BslTitle", "WtfplTitle", "CcZero")
#: Sentences that take in all up to their end.
_TAILED = frozenset(name for name, pattern in SENTENCES if pattern.endswith(".*"))
_MAYBE = re.compile("|".join(f"(?:{re.sub(r'[?]P<[a-z]+>', '?:', pattern)})" for name, pattern in SENTENCES if name not in _ONE_LINE))
_ANY = re.compile(r"licen[sc]e|permission|redistribut|warrant")
_HINT = re.compile(HINT)
_NOTICE = ("Copyright", "AllRights")
_MARKS = re.compile(r"[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--|%+|>+|\||dnl\b|REM\b)?[ \t]*")
#: Where a sentence may begin although none ended: notices are often run together on one line.
_BEGINS = r"Permission is hereby granted|Permission to use|Redistribution and use in|Licensed (?:under|to)|All rights reserved|This (?:program|library|software|file) is (?:free|licensed|provided|distributed)|The above copyright notice and|THE SOFTWARE IS"
_BREAK = re.compile(rf"(?<=[.!?;])[\"”)]*\s+(?=[A-Z\"“(]|\d[.)]\s)|(?<=:)\s+(?=[(*-]|\d[.)])|\s+(?={_BEGINS})")
_LINK = re.compile(r"\w+://\S+")
_ENDS = re.compile(r"[.!?;:][\"”)]*[ \t]*(?:\*/)?[ \t]*$")


def normalise(sentence: str) -> str:
    """Lower case; everything but letters, digits and dots within numbers becomes a blank; blanks are squeezed."""
    low = re.sub(r"\(c\)", "copyright", sentence.lower())
    low = re.sub(r"copyright copyright|copyright ©", "copyright", low)
    low = re.sub(r"(?<!\d)\.|\.(?!\d)", " ", low)
    return " ".join(re.sub(r"[^\w.©+]+|_", " ", low).split())


def split(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, open) of the pieces of a text: lines without comment marks, cut where a sentence ends within.

    ``open`` tells that the next piece may go on with the sentence: its line follows at once, and no sentence ends here.
    """
    out, at = [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        begin, end = at + _MARKS.match(line).end(), at + len(line)
        at += len(line) + 1
        if not text[begin:end].strip():
            continue
        more = k + 1 < len(lines) and bool(lines[k + 1][_MARKS.match(lines[k + 1]).end() :].strip())
        for stop in _BREAK.finditer(text, begin, end):
            if stop.start() > begin:
                out.append((begin, stop.start(), False))
            begin = stop.end()
        if begin < end:
            out.append((begin, end, more and not _ENDS.search(text, begin, end)))
    return out


def _known(norm: str) -> tuple[str, str] | None:
    """(identifier, version) of a normalised sentence."""
    for name, pattern in _SENTENCE:
        if m := pattern.fullmatch(norm):
            found = m.groupdict()
            if name == "CcNamed":
                return name, "-".join(["BY", *[k.upper() for k in ("nc", "nd", "sa") if found.get(k)], found["n"]])
            return name, (found.get("v") or "").replace(" ", "-").upper()
    return None


def identify(text: str) -> list[tuple[str, str, int, int]]:
    """(identifier, version, start, stop) of the known sentences; other sentences that speak of licences are ``Unknown``.

    Only pieces around a word of HINT are looked at, and a piece is read on over its line's end while the table has a
    sentence that may go on so; a line of any length is looked up whole.
    """
    hints = [m.start() for m in _HINT.finditer(text)]
    if not hints:
        return []
    pieces, out, k = split(text), [], 0
    starts = [a for a, _, _ in pieces]
    marked = [False] * len(pieces)
    for h in hints:
        marked[max(0, bisect_right(starts, h) - 1)] = True
    # the sentence of a marked piece may begin in the pieces before it
    for i in range(len(pieces) - 2, -1, -1):
        marked[i] = marked[i] or marked[i + 1] and pieces[i][2]
    while k < len(pieces):
        a, b, open_ = pieces[k]
        if not marked[k]:
            k += 1
            continue
        norm = normalise(text[a:b])
        found, last, j, said = _known(norm), k, k, norm
        if found is None or found[0] not in _ONE_LINE:
            while pieces[j][2] and j + 1 < len(pieces):
                if found and found[0] in _TAILED:  # all that follows belongs to it
                    j = last = j + 1
                    continue
                if not _MAYBE.fullmatch(said, partial=True):
                    break
                j += 1
                said = f"{said} {normalise(text[pieces[j][0] : pieces[j][1]])}"
                if longer := _known(said):
                    found, last = longer, j
        if found:
            out.append((*found, a, pieces[last][1]))
            k = last + 1
            continue
        if _ANY.search(normalise(_LINK.sub(" ", text[a:b]))):
            out.append(("Unknown", "", a, b))
        k += 1
    return out


def licences(found: list[tuple[str, str, int, int]]) -> list[str]:
    """Licences by the ordered rules, in order of their first sentences; a sentence serves one rule.

    A copyright notice within a licence or right before it belongs to that licence.
    """
    names, used, out = [f[0] for f in found], [False] * len(found), []
    held: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        held.setdefault(name, []).append(i)
    for rule in RULES:
        needed = [step for step in rule.sequence if not step.endswith("?")]
        if any(step not in held for step in needed):
            continue
        at = 0
        while at < len(names) and all(held[step][-1] >= at for step in needed):
            took, i, k = [], at, 0
            while k < len(rule.sequence):
                want, free = rule.sequence[k].rstrip("?"), rule.sequence[k].endswith("?")
                while i < len(names) and (used[i] or names[i] in (*_NOTICE, "Unknown") and want != names[i]):
                    i += 1
                if i < len(names) and names[i] == want:
                    took.append(i)
                    i += 1
                elif not free:
                    break
                k += 1
            if k < len(rule.sequence) or not took:
                at += 1
                continue
            for t in took:
                used[t] = True
            first = took[0]
            while first and names[first - 1] in _NOTICE:
                first -= 1
            for t in range(first, took[-1]):
                used[t] = used[t] or names[t] in _NOTICE
            out.append((took[0], rule.licence.format(v=next((found[t][1] for t in took if found[t][1]), "")).rstrip("-")))
            at = took[-1] + 1
    return [name for _, name in sorted(out)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, sentences, n_unknown) of each row.

    ``sentences`` holds (identifier, version, start, stop) in order. Null and empty texts have none; repeated rows are
    scanned alike; of rules that fit the same sentences the earlier one wins. Other columns are ignored, whatever their
    names; an empty table gives an empty result. One pass without a shuffle; a text of any length goes in whole, and texts
    without any licence word are settled by one linear search.
    """
    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    kind = pa.list_(pa.struct([("identifier", pa.string()), ("version", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            sentences: list = [[] for _ in range(len(texts))]
            names: list = [[] for _ in range(len(texts))]
            for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False)).to_pylist():
                sentences[i] = identify(texts[i].as_py())
                names[i] = licences(sentences[i])
            flat = [[dict(zip(("identifier", "version", "start", "stop"), s, strict=True)) for s in x] for x in sentences]
            unknown = pa.array([sum(s[0] == "Unknown" for s in x) for x in sentences], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(flat, kind), unknown], ["doc_id", "licences", "sentences", "n_unknown"])

    made = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licences array<string>, sentences array<struct<identifier:string,version:string,start:int,stop:int>>, n_unknown int"
    return rows.mapInArrow(run, made)
