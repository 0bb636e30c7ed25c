import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, decontaminate, html_wrapper, licenses, mixing, near_duplicates, ordinal, pii, quality_rules, suffix_dedup, url_filter
from tessera.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.com/en/9", "http://b.net/de/1", "http://example.net/de/8", "http://x.org/fr/", None, "no-scheme", "http://com/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.url_filter(pages, url_filter.rules_frame(spark, RULES)).orderBy("page_id").collect()
    assert [(r.host, r.rule, r.verdict) for r in got] == [
        ("a.example.com", "example.com/en/7", "allow"), ("example.com", "com/en/", "block"), ("b.net", "net/de/", "allow"), ("example.net", "example.net/de/8", "block"),
        ("x.org", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("com", "com/en/", "block"), ("com", "com/en/", "block"),
    ]
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_frame(spark, RULES)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_url_filter_many_shapes(spark):
    """No limit on how many shapes rules have; ties, null rules, repeated rules and a long url."""
    rules = spark.createDataFrame([("a.com/" + "x" * k, "block") for k in range(4200)] + [("b.com/y", "allow"), ("b.com/y", "block"), (None, "block"), ("", "block"), ("/z", "block")], "rule string, verdict string")
    urls = ["http://a.com/" + "x" * 4000 + "?q", "http://w.a.com/" + "x" * 9000, "http://a.com/", "http://b.com/y/z", "http://c.com/z", "http://" + "s." * 300 + "b.com/yy"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [len(r.rule or "") for r in got] == [4006, 4205, 6, 7, 0, 7] and [r.verdict for r in got] == ["block"] * 4 + ["allow", "block"]


def test_quality_rules(spark):
    text = prose(1, 60) + ".\na | b | c | d\n" + prose(2, 10) + "."
    rows = [(1, text, "a"), (2, None, "a"), (3, "", "a"), (4, "x y z " * 30, "a"), (5, "\n".join(["go | home | news | shop"] * 40), "a"), (1, text, "a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows).withColumnRenamed("n_chars", "kept")).collect()}
    assert got[1].kept and got[1].n_bad_lines == 1 and "|" not in got[1].cleaned
    assert got[2].n_words == got[3].n_words == 0 and got[2].base_failed and not got[3].kept
    assert got[4].n_repeat_words == 90 and got[4].base_failed
    assert not got[5].kept and got[5].n_dup_lines == 39
    assert quality_rules.quality_rules(docs(spark, rows)).where("kept").count() == 2


def test_quality_lines(spark):
    """Each kind of failing line goes, its neighbours stay; ties, clashing columns, long texts and an empty table."""
    good, long = prose(1, 40) + ".", (prose(2, 30) + ".\n") * 3000
    bad = ["Home About Products Contact", "a | b | c", "### $$$ %%% x", "Buy! Now! Here!", prose(3, 70), "Alle Rechte vorbehalten", "MENTIONS LÉGALES", "Política de privacidad y más", "Impressum", "skip to content"]
    fine = ["A Short Title", "Home", "Home about products contact", "See: Home About Products", "Berlin, Paris And Rome"]
    rows = [(k, f"{good}\n{line}\n{good}", "a") for k, line in enumerate([*bad, *fine])] + [(100, long, "a"), (100, long, "a")]
    made = docs(spark, rows).withColumnRenamed("lang", "__t").withColumnRenamed("n_chars", "__w").withColumnRenamed("source", "__f")
    got = quality_rules.quality_rules(made).collect()
    assert {r.doc_id for r in got if r.n_bad_lines == 1} == set(range(len(bad))) and all(r["__t"] == "en" and r["__f"] == "a" for r in got)
    assert all(r.cleaned == f"{good}\n{good}" for r in got if r.doc_id < len(bad))
    assert [(r.n_bad_lines, r.n_dup_lines, r.base_failed) for r in got if r.doc_id == 100] == [(0, 2999, True)] * 2
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        x = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(40))]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("array_runs", [2000, 2])
def test_suffix_dedup(spark, monkeypatch, array_runs):
    shared = prose(5, 60)
    texts = [prose(i, 40) + " " + shared[k : k + 250] + " " + prose(i + 90, 40) for i, k in enumerate((0, 3, 0, 40, 7, 0))]
    rows = [*enumerate(texts), (6, texts[0]), (7, "ab" * 400), (8, None), (9, ""), (10, "é" * 120), (11, texts[2] + texts[3]), (12, "x" * 99)]
    monkeypatch.setattr(suffix_dedup, "ARRAY_RUNS", array_runs)
    got = suffix_dedup.kept(*suffix_dedup.suffix_dedup(docs(spark, [(i, t, "s") for i, t in rows])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_repeats(rows, 100)
    assert suffix_dedup.kept(*suffix_dedup.suffix_dedup(docs(spark, rows and []))).count() == 0


def test_suffix_dedup_long_and_odd_rows(spark):
    """A long text, repeated rows, rows without an id, clashing columns and an empty table."""
    shared = prose(8, 80)
    long = " ".join(prose(100 + k, 200) + " " + (shared if k % 7 == 0 else "") for k in range(60))
    rows = [(1, "intro " + shared), (2, long), (3, long[1000:90_000]), (4, shared[:99]), (5, None)]
    made = docs(spark, [(i, t, "s") for i, t in rows] + [(None, long, "s")]).withColumnRenamed("lang", "anchor").withColumnRenamed("source", "kept")
    got = suffix_dedup.kept(*suffix_dedup.suffix_dedup(made)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == brute_repeats(rows, 100)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    twice = suffix_dedup.kept(*suffix_dedup.suffix_dedup(docs(spark, [(1, shared, "s"), (1, shared, "s"), (2, shared, "s")]))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 0), (1, 0), (2, len(shared))]


def test_pii(spark):
    text = "Ask Mrs. Anna Smith, anna.smith@corp.com or +1 (017) 555-7713; 97.51.17.173, 4111 1111 1111 1111, token = \"269b1cea0846965f2d3ecb5cdb87c0edc7a7a587\"."
    base = docs(spark, [(1, text, "a"), (2, "Mrs. Anna Smith wrote to ANNA.smith@corp.com", "a"), (3, None, "a"), (4, "plain", "a"), (5, "", "a"), (1, text, "a")])
    done = pii.pseudonymise(base, "k")
    got = {r.doc_id: r for r in done.collect()}
    new = got[1].text
    assert [p.type for p in got[1].pii] == ["name", "email", "phone", "ip", "card", "secret"]
    assert not any(x in new for x in ("Anna", "Smith", "corp", "555-7713", "97.51.17.173", "4111 1111", "269b1cea"))
    for p in got[1].pii:
        assert new[p.new_start : p.new_start + len(p.surrogate)] == p.surrogate
    card = re.sub(r"\D", "", got[1].pii[4].surrogate)
    assert pii.luhn(card[:-1]) == int(card[-1])
    first = got[1].pii[0].surrogate
    assert first.split()[0] in pii.GIVEN["latin", "f"] and got[2].pii[0].surrogate == first and got[2].pii[1].surrogate == got[1].pii[1].surrogate
    assert got[3].text is None and got[4].text == "plain" and got[4].pii == []
    assert pii.collisions(done).count() == 0 and pii.torn(done).count() == 0


def test_pii_later_mentions(spark):
    """A person keeps one surrogate, in whole and in part, in this document and in others; other words stay."""
    text = "Mrs. Anna Smith signed. Later Anna Smith and Smith agreed. John Miller said so: Miller, not Milland. Call 555-123-4567 or (555) 123-4567, 06 12 34 56 78."
    rows = [(1, text, "a"), (2, "Mr Miller and Jean-Pierre O'Neill. Smithy and Smith stay.", "a"), (3, "Herr Smith", "a")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "k").collect()}
    new = got[1].text
    assert not re.search("Anna|Smith|John|Miller[^a]|555|06 12", new) and "Milland" in new and "Smithy and Smith stay" in got[2].text
    anna, smith = re.match(r"Mrs\. (\w+) (\w+) signed\. Later (?:\1 \2) and (?:\2) agreed", new).groups()
    assert anna in pii.GIVEN["latin", "f"] and got[3].text == f"Herr {smith}" and len(smith) == 5
    miller = re.search(r"agreed\. (\w+) (\w+) said so: \2, not", new)
    assert miller[1] in pii.GIVEN["latin", "m"] and got[2].text.startswith(f"Mr {miller[2]} and ")
    assert re.search(r"Call (\d{3})-(\d{3})-(\d{4}) or \(\1\) \2-\3, 0\d( \d\d){4}\.", new)
    for r in got.values():
        for p in r.pii:
            assert r.text[p.new_start : p.new_start + len(p.surrogate)] == p.surrogate


def test_pii_names_are_a_permutation():
    """No two names of a shape meet, none stays, a female ending stays one, and capitals and joints stay in place."""
    import itertools

    names = ["".join(x).capitalize() for x in itertools.product(["s", "st", "sx", "q"], ["a", "ae", "ai", "é"], ["n", "nn", "nq", "rth"], ["", "a", "o", "y"])]
    for role, gender in (("surname", ""), ("given", "f"), ("given", "m")):
        made = [pii.name_part(n, role, gender, b"k") for n in names]
        assert len(set(made)) == len(names) and not any(a == b for a, b in zip(names, made, strict=True))
        assert all((a[-1] in "aei") == (b[-1] in "aei") and len(a) == len(b) and b[0].isupper() for a, b in zip(names, made, strict=True))
    assert re.fullmatch(r"O'[A-Z]\w+-[A-Z]\w+", pii.name_part("O'Brien-Li", "surname", "", b"k").replace(pii.name_part("O'Brien-Li", "surname", "", b"k")[0], "O", 1))


def test_pii_accounts_stay_valid():
    valid = lambda v: int("".join(str(int(c, 36)) for c in v.replace(" ", "")[4:] + v[:4])) % 97 == 1
    for good in ("DE44 5001 0517 5407 3249 31", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"):
        new = pii.surrogate("iban", good, "", b"k")
        assert valid(good) and valid(new) and new[:2] == good[:2] and new != good and [c == " " for c in new] == [c == " " for c in good]
        assert pii.surrogate("iban", good.replace(" ", ""), "", b"k") == new.replace(" ", "")
    assert not valid(pii.surrogate("iban", "DE45 5001 0517 5407 3249 31", "", b"k"))


def test_pii_checks(spark):
    base = docs(spark, [(1, "mail a.b@corp.com and token=abcdefghij0123456789", "a"), (2, "A.B@corp.com", "a"), (3, None, "a"), (4, "plain", "a"), (1, "again a.b@corp.com", "a"), (None, "a.b@corp.com", "a")])
    done = pii.pseudonymise(base, "k").withColumnRenamed("lang", "pii_checks")
    got = pii.checked(done).collect()
    assert len(got) == 6 and all(r.pii_checks == [] for r in got)
    # a second corpus whose originals are spelled like surrogates of the first, and surrogates that meet or part
    echo = next(p for r in got if r.doc_id == 2 for p in r.pii).surrogate
    more = pii.pseudonymise(docs(spark, [(7, f"write to {echo}", "a")]), "k")
    both = done.select("doc_id", "text", "pii").unionByName(more.select("doc_id", "text", "pii"))
    assert {r.doc_id for r in pii.checked(both).where("array_contains(pii_checks, 'echo')").collect()} == {1, 2}
    other = pii.pseudonymise(base, "another key").select("doc_id", "text", "pii")
    from pyspark.sql import functions as F

    same = other.withColumn("pii", F.transform("pii", lambda p: p.withField("entity", F.lit("x"))))
    assert {r.doc_id for r in pii.checked(same).where("array_contains(pii_checks, 'torn')").collect()} == set()  # one form each type
    met = done.select("doc_id", "text", "pii").withColumn("pii", F.transform("pii", lambda p: p.withField("form", F.lit("y")).withField("entity", F.concat(p["entity"], F.col("doc_id").cast("string")))))
    assert {r.doc_id for r in pii.checked(met).where("array_contains(pii_checks, 'collision')").collect()} == {1, 2}
    with pytest.raises(ValueError, match="secret key"):
        pii.pseudonymise(base, "")


def test_pii_edges(spark):
    long = "x " * 300_000 + "Mrs. Anna Smith " + "y " * 1000 + "Smith"
    rows = [(1, long, "a"), (1, long, "a"), (2, "Mr. Bo Ek " * 3000, "a")]
    got = pii.pseudonymise(docs(spark, rows).withColumnRenamed("lang", "pii"), "k").collect()
    assert [len(r.pii) for r in got if r.doc_id == 1] == [2, 2] and len(next(r for r in got if r.doc_id == 2).pii) == 3000
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


def test_pii_hint_covers_patterns(spark):
    said = {
        "email": ["a@b.com"], "ip": ["97.51.17.173"], "iban": ["DE44 5001 0517 5407 3249 31"], "card": ["4111 1111 1111 1111"], "ssn": ["123-45-6789"], "phone": ["+49 171 555 7713", "+٤٩ ١٧١ ٥٥٥ ٧٧١٣"],
        "secret": ["password: correct-horse-battery-staple", "api_key=AbCdEfGhIjKlMnOpQr", "APIKEY = 'AbCdEfGhIjKlMnOpQr'", "Token=\tAbCdEfGhIjKlMnOpQr", "\u017fecret:AbCdEfGhIjKlMnOpQr", "passwd: AbCdEfGhIjKlMnOpQr", "access-key: AbCdEfGhIjKlMnOpQr", "ap\u0130_key: AbCdEfGhIjKlMnOpQr"],
        "name": ["Anna Ek", "Jean-Pierre Ek", "Иван Петров", "Maria J. Ek"] + [f"{t} Bo Ek" for t in ("Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme")] + ["г-н Иван Ива", "г-жа Анна Ива"],
    }
    assert sorted(said) == sorted(pii.TYPES)
    rows = [(kind, text) for kind, texts in said.items() for text in texts]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, [(i, text, "a") for i, (_, text) in enumerate(rows)]), "k").collect()}
    for i, (kind, text) in enumerate(rows):
        assert [p.type for p in got[i].pii] == [kind] and got[i].text != text, text


def test_permutation_is_one_cycle():
    for size in (2, 7, 100, 257):
        image = [pii.permute(x, size, b"k", "t") for x in range(size)]
        assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))


def test_licenses(spark):
    rows = [(1, "Text.\nReleased under the MIT License.", "a"), (2, "This work is licensed under the GNU General Public License, version 3.", "a"), (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "a"), (4, None, "a"), (5, "no such thing", "a"), (6, "See the license terms we wrote.", "a")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[1].licences == ["MIT"] and got[2].licences == ["GPL-3"] and got[3].licences == ["CC-BY-NC-4.0", "Apache-2.0"]
    assert got[4].licences == got[5].licences == got[6].licences == [] and got[6].n_unknown == 1


def test_licenses_every_sentence(spark):
    said = {
        "Copyright": "(c) 2020 A", "AllRights": "All rights-reserved.", "Spdx": "SPDX-License-Identifier: MIT", "ApacheRef": "Licensed under the Apache License, Version 2.0", "ApacheUse": "you may not use this file except in compliance with the License",
        "ApacheCopy": "You may obtain a copy of the License at x", "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
        "MitRef": "Released under the MIT licence", "MitTitle": "The MIT License", "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "AsIs": "The software is provided 'as\u00a0is'", "BsdUse": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BsdSource": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice", "BsdNames": "Neither the name of A nor B may be used to endorse or promote products derived from this software", "GplRef": "under the GNU General Public License, version 3", "LgplRef": "under the GNU Lesser General Public License version 2.1",
        "OrLater": "at your option any later  version", "GplNoWarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "MplRef": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "CcRef": "Licensed under CC BY 4.0", "PublicDomain": "This work is in the public-domain",
        "MitLiability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "IscTitle": "The ISC License", "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ZeroGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "IscAsIs": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE', "IscLiability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
        "ZlibTitle": "zlib License", "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.", "ZlibLiability": "In no event will the authors be held liable for any damages arising from the use of this software.",
        "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "ZlibOrigin": "1. The origin of this software must not be misrepresented; you must not claim that you wrote it",
        "ZlibCredit": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "ZlibAltered": "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "ZlibNotice": "3. This notice may not be removed or altered from any source distribution.",
        "BsdTitle": "BSD 3-Clause License", "BsdRef": "Released under the BSD 2-Clause License", "BsdAsIs": 'THIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES', "BsdLiability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "ApacheTitle": "Apache License", "ApacheGrant": "The ASF licenses this file to you under the Apache License, Version 2.0", "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.", "ApacheTeam": "Licensed to the ASF under one or more contributor license agreements.",
        "ApacheNotice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.", "MplTitle": "Mozilla Public License Version 2.0", "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at x", "EplRef": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "BslTitle": "Boost Software License - Version 1.0", "BslRef": "Distributed under the Boost Software License, Version 1.0", "BslGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "UnlicensePublic": "This is free and unencumbered software released into the public domain.", "UnlicenseGrant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form", "UnlicenseLaws": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all interest",
        "WtfplTitle": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WtfplGrant": "0. You just DO WHAT THE FUCK YOU WANT TO.", "CcZero": "CC0 1.0 Universal license", "CcNamed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "GnuSee": "See the GNU General Public License for more details.", "GnuCopy": "You should have received a copy of the GNU Affero General Public License along with this program", "GplGrant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        **{f"{n}LaterGrant": f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU {g}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for n, g in (("Gpl", ""), ("Lgpl", "Lesser "), ("Agpl", "Affero "))},
        **{f"{n}Grant": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {g}General Public License as published by the Free Software Foundation, version 3." for n, g in (("Lgpl", "Lesser "), ("Agpl", "Affero "))},
        **{f"{n}LaterRef": f"Licensed under the GNU {g}General Public License v3 or later" for n, g in (("Gpl", ""), ("Lgpl", "Lesser "), ("Agpl", "Affero "))}, "AgplRef": "GNU Affero General Public License v3",
    }
    names = list(dict.fromkeys(n for n, _ in licenses.SENTENCES))
    assert sorted(said) == sorted(names)
    rows = [*((i, said[n], "a") for i, n in enumerate(names)), (100, "(c) 2020 A. All rights reserved.", "a"), (101, "The MIT License\nCopyright A\nAll rights reserved.\n" + said["MitGrant"], "a"), (102, "copyright A " + "x " * 3000, "a"), (103, "we give a license " + "x " * 3000, "a")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [[s.identifier for s in got[i].sentences] for i in range(len(names))] == [[n] for n in names]
    assert got[100].licences == ["Proprietary"] and got[101].licences == ["MIT"]
    assert [s.identifier for s in got[102].sentences] == ["Copyright"] and got[103].n_unknown == 1


LICENCES = {
    "MIT": """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}


def test_licenses_wrapped_and_run_together(spark):
    """Published texts as they are wrapped, in a comment, on one line, wrapped anew, and amid other text."""
    rng, rows = random.Random(3), []
    for name, text in LICENCES.items():
        words = text.replace("\n\n", " \0 ").split()
        anew = " ".join(w + ("\n" if rng.random() < 0.15 else "") for w in words).replace(" \0 ", "\n\n").replace("\0", "\n\n")
        forms = [text, "/*\n" + "\n".join(" * " + line for line in text.splitlines()) + "\n */", "# " + text.replace("\n", "\n# "), " ".join(text.split()), anew, prose(1, 30) + ".\n\n" + text + "\n\n" + prose(2, 30)]
        rows += [(len(rows) + k, f, name) for k, f in enumerate(forms)]
    got = {r.doc_id: r.licences for r in licenses.scan(docs(spark, rows)).collect()}
    assert [(i, got[i]) for i, _, name in rows if got[i] != [name]] == []


def test_licenses_edges(spark):
    long = "word " * 200_000
    rows = [(1, long + ". Released under the MIT License.", "a"), (1, long + ". Released under the MIT License.", "a"), (2, "see the license\n" * 20_000, "a"), (3, "copyright me\n" * 20_000, "a")]
    got = licenses.scan(docs(spark, rows).withColumnRenamed("lang", "licences")).collect()
    assert sorted((r.doc_id, r.licences, r.n_unknown) for r in got) == [(1, ["MIT"], 0), (1, ["MIT"], 0), (2, [], 20_000), (3, [], 0)]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_ordinal_held_out():
    rng = random.Random(1)
    texts, grades = [], []
    for i in range(3000):
        g = i % 3
        extra = {0: ["vile", "awful"], 1: ["spam%%", "buy%%"], 2: []}[g]
        words = [rng.choice(WORDS) for _ in range(40)] + extra * 2
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    grades = np.array(grades)
    model = ordinal.fit(pa.array(texts[:2000]), grades[:2000])
    assert (np.diff(model.thresholds) > 0).all() and model.history[-1] < model.history[0]
    tails = np.concatenate([model.tails(*ordinal.features(raw, at), b - a) for a, b, raw, at in ordinal.parts(pa.array(texts[2000:]))])
    assert (((tails >= 0.5).sum(axis=1)) == grades[2000:]).mean() > 0.95


def test_ordinal_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    base = docs(spark, [*((i, "good fine words" if i % 2 else "bad%% worse%%", "a") for i in range(40)), (50, None, "a"), (51, "", "a")])
    got = ordinal.score(base, ordinal.train(base, labels)).collect()
    assert len(got) == 42 and all(0 <= t <= 1 for r in got for t in r.tail)


def test_ordinal_any_labels(spark):
    base = docs(spark, [*((i, f"some words {i % 3}", "a") for i in range(30)), (3, "some words 0", "a"), (40, None, "a")]).withColumnRenamed("lang", "tail")
    for rows in ([], [(i, 1, 0) for i in range(30)], [(i, 0, 1) for i in range(30)], [(i, i % 2, None) for i in range(30)], [(5, 1, 0), (5, 0, 0), (None, 1, 0), (999, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = ordinal.select(ordinal.score(base, ordinal.train(base, labels)), above=1).collect()
        assert len(got) == 32 and all(len(r.tail) == 2 and r.tail[0] > r.tail[1] and r.kept in (True, False) for r in got)
    assert ordinal.score(base.limit(0), ordinal.train(base.limit(0), labels)).count() == 0


def test_mixing(spark):
    rows = [(i, prose(i, 30 + i % 7), ("a", "b", "c", None)[i % 4] if i > 4 else "tiny") for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (7, rows[7][1], rows[7][2])]
    mixes = [mixing.mix(docs(spark, rows), block=16) for _ in range(2)]
    first, again = (sorted(map(tuple, mixing.taken(m).collect()), key=repr) for m in mixes)
    assert first == again and len(first) == len(rows)
    for s in mixes[0].sources:
        got = sum(t[4] for t in first if t[2] == s.size and t[3] == s.target)
        assert abs(got - s.target) <= 64 and s.target <= 3 * s.size + 1e-6
    assert all(t[4] <= 3 * t[1] for t in first)
    assert sum(s.target for s in mixes[0].sources) == pytest.approx(sum(s.size for s in mixes[0].sources))
    assert mixing.taken(mixing.mix(docs(spark, []))).count() == 0


def test_mixing_many_sources(spark, monkeypatch):
    """Sources that the executors plan get what the driver would plan; there is no limit to their number."""
    rows = [(i, prose(i, 20 + i % 9), [None, "", "é", *"abcdefgh"][i * i % 11]) for i in range(300)] + [(1000, None, "empty"), (1001, "one", "tiny")]
    base = docs(spark, rows).withColumnRenamed("lang", "taken")
    want = sorted(map(tuple, mixing.taken(mixing.mix(base, block=16)).collect()), key=repr)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    got = sorted(map(tuple, mixing.taken(mixing.mix(base, block=16)).collect()), key=repr)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want] and all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(3 + id % 5 as int)) as text", "concat('s', id) as source")
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1000)
    n, took, words, over = mixing.taken(mixing.mix(many)).selectExpr("count(*)", "sum(taken)", "sum(size)", "max(taken - 3 * size)").first()
    assert n == 20_000 and over <= 0 and abs(took - words) <= 0.02 * words
    assert mixing.taken(mixing.mix(docs(spark, []))).count() == 0


def test_mixed_corpus(spark):
    rows = [(i, prose(i, 30 + i % 7), "ab"[i % 2]) for i in range(60)] + [(None, prose(500 + i % 3, 30), "a") for i in range(6)] + [(3, prose(3, 33), "b"), (70, prose(1, 9000), "b")]
    base = docs(spark, rows).withColumnRenamed("n_chars", "target")
    m = mixing.mix(base, block=16)
    got = mixing.mixed(base, m).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(r.taken for r in mixing.taken(m).collect()) > 0
    assert all(r.size == len(r.text.split()) and r.taken <= 3 * r.size for r in got)


def test_mixing_small_sources(spark):
    rows = [(i, prose(i, 60), "big" if i % 2 else "main") for i in range(400)] + [(1000 + i, prose(i, 20 + i), f"tail{i:02}") for i in range(20)]
    m = mixing.mix(docs(spark, rows))
    got = {}
    for t in mixing.taken(m).collect():
        got[t.source_size, t.target] = got.get((t.source_size, t.target), 0) + t.taken
    for s in m.sources:
        assert abs(got[s.size, s.target] - s.target) <= max(16, 0.1 * s.target), s
    assert mixing.fitting([5e9, 10.0], 256) == math.ceil((5e9 + 10) / mixing.MOST_SLOTS) and mixing.fitting([1e6, 2000.0], 256) == mixing.fitting([], 256) == 256


PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>Home</a></nav><div class='ad'>buy</div><article><h1>Title &amp; more</h1><p><b>One  two<br><p>three&nbsp;four</p>%s</article><footer>foot</footer></body></html>"


def html_texts(spark, rows):
    made = html_wrapper.main_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(r.page_id for r in made) == sorted(r[0] for r in rows)
    return {r.page_id: r.text for r in made}


def test_html(spark):
    rows = [(i, f"http://h{i}.com/{i}", PAGE % f"<p>body {i}</p><div class='comments'>me too</div>") for i in range(6)]
    rows += [(10, None, PAGE % "<p>x</p>"), (11, "http://h0.com/n", None), (12, "http://h0.com/e", ""), (13, "http://solo.org/", "<p>just text<p>more"), (0, rows[0][1], rows[0][2])]
    texts = html_texts(spark, rows)
    assert texts[3] == "Title & more\nOne two\nthree four\nbody 3"
    assert texts[10].endswith("x") and texts[11] == texts[12] == "" and texts[13] == "just text\nmore"
    assert html_texts(spark, []) == {}


def test_html_template_goes(spark):
    """Nothing but the alignment tells these texts apart: no tag or class says what they are."""
    page = "<html><body><div><p>Great Site</p><p>of ours</p></div><div><h1>Title %d</h1><p>%s</p><p>Read more on our other pages</p></div><div><p>Made by us</p></div></body></html>"
    rows = [(i, f"http://many.com/{i}", page % (i, prose(i, 20))) for i in range(5)]
    rows += [(5, "http://many.com/copy", rows[0][2]), (5, "http://many.com/copy", rows[0][2])]
    rows += [(i, f"http://two.com/{i}", page % (i, prose(i, 90))) for i in (10, 11)]
    rows += [(20, "http://alone.com/", page % (20, prose(20, 20)))]
    texts = html_texts(spark, rows)
    for i in (0, 1, 2, 3, 4, 10, 11):
        assert texts[i] == f"Title {i}\n{prose(i, 20 if i < 10 else 90)}"
    assert texts[5] == texts[0]
    assert texts[20] == f"Great Site\nof ours\nTitle 20\n{prose(20, 20)}\nRead more on our other pages\nMade by us"


def test_html_copies_are_no_template(spark):
    page = "<html><body><div><h1>%s</h1><p>%s</p><p>%s</p></div></body></html>"
    same = page % ("Copied", prose(1, 30), prose(2, 30))
    rows = [(i, f"http://c.com/{i}", same) for i in range(12)]
    rows += [(20 + i, f"http://n.com/{i}", page % ("Near", prose(3, 60), prose(4, 30) + f" {i}")) for i in range(2)]  # near copies, a host of two
    texts = html_texts(spark, rows + [(99, "http://c.com/other", page % ("Other", prose(5, 30), prose(6, 30)))])
    assert {texts[i] for i in range(12)} == {f"Copied\n{prose(1, 30)}\n{prose(2, 30)}"}
    assert texts[20] == f"Near\n{prose(3, 60)}\n{prose(4, 30)} 0" and texts[99].startswith("Other\n")


def test_html_deep_and_wide_pages(spark):
    rng = random.Random(2)
    some = ("<p>%s</p>", "<ul><li>%s</li></ul>", "<h2>%s</h2>", "<div><p>%s</p><p>x</p></div>", "<p><b>%s</b></p>")
    deep = ["<div>" * (3000 + i) + f"deep {i}" + "</div>" * 3000 for i in range(2)]
    wide = ["<div>" + "".join(rng.choice(some) % rng.random() for _ in range(3000)) + "</div>" for _ in range(2)]
    texts = html_texts(spark, [(i, f"http://h.com/{i}", h) for i, h in enumerate(deep + wide)])
    assert texts[0] == "deep 0" and texts[1] == "deep 1" and texts[2].count("\n") >= 2999


def test_html_form_around_the_page():
    said = "<h1>Title</h1><p>" + prose(3, 40) + "</p>"
    assert html_wrapper.extract(f"<body><form id='aspnetForm'><div>{said}</div><form><label>mail</label></form></form></body>") == "Title\n" + prose(3, 40)
    assert html_wrapper.extract(f"<body><div>{said}</div><form><label>your name</label> and more</form></body>") == "Title\n" + prose(3, 40)


def test_html_compound_classes():
    said = "<h1>Title</h1><p>" + prose(3, 40) + "</p>"
    for page in ("<body class='has-sidebar'>%s</body>", "<div id='page' class='no-sidebar social'>%s</div>", "<article class='post comments-open'>%s</article>", "<main class='search-results'>%s</main>", "<body><div class='sidebar-right'>%s</div><p>end</p></body>", "<body class='search'><div class='widget hasSidebar'>%s</div></body>"):
        assert prose(3, 40) in html_wrapper.extract(page % said), page
    for role in ("class='comments'", "class='site-footer'", "id='cookieNotice'", "class='x comment-list'", "role=navigation", "class='ad-300x250'"):
        assert html_wrapper.extract(f"<body><div {role}>apart</div><div>{said}<div {role}>apart</div></div></body>") == "Title\n" + prose(3, 40), role
    many = "<article class='comment'>" + prose(4, 30) + "</article>"
    assert html_wrapper.extract(f"<body><div>{said}</div><div class='comments'>{many * 2}</div></body>") == "Title\n" + prose(3, 40)


def test_html_whole_region(spark):
    page = "<html><body><nav>menu</nav><div class='post'><h1>Title %d</h1><p>Intro %d</p><div class='entry'><p>%s</p></div><p>Close %d</p></div><div><p>Always the same</p></div></body></html>"
    other = "<html><body><div class='post'><p>short %d</p></div><section><h1>Other %d</h1><p>%s</p></section></body></html>"
    rows = [(i, f"http://h.com/{i}", page % (i, i, prose(i, 200), i)) for i in range(1, 6)] + [(i, f"http://h.com/{i}", other % (i, i, prose(i, 30))) for i in (8, 9)]
    rows += [(20, "http://solo.org/", page % (20, 20, prose(20, 200), 20))]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (1, 2, 3, 4, 5, 20):
        assert f"Title {i}\nIntro {i}\n{prose(i, 200)}\nClose {i}" in got[i]
    for i in (8, 9):
        assert got[i] == f"short {i}\nOther {i}\n{prose(i, 30)}"


def brute_match(a, b, x=0, y=0):
    if a.tag[x] != b.tag[y]:
        return 0
    ka, kb = a.kids[x], b.kids[y]
    m = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i, p in enumerate(ka):
        for j, q in enumerate(kb):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(a, b, p, q))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_tree_matching(monkeypatch, cells):
    monkeypatch.setattr(html_wrapper, "TABLE_CELLS", cells)
    a, b = html_wrapper.Page("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), html_wrapper.Page("<div><p>1</p><p>2</p></div>")
    assert len(html_wrapper.match(a.tag, a.kids, b.tag, b.kids)) == 4
    rng = random.Random(4)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(("<i>t</i>", "<b>t</b>"))
        return rng.choice(("<div>%s</div>", "<span>%s</span>")) % "".join(tree(depth - 1) for _ in range(rng.randrange(4)))

    for _ in range(200):
        a, b = (html_wrapper.Page("<div>" + tree(3) + tree(3) + tree(2) + "</div>") for _ in range(2))
        got = html_wrapper.match(a.tag, a.kids, b.tag, b.kids)
        pair = dict(got)
        assert len(got) == brute_match(a, b) == len(pair) == len(set(pair.values()))
        assert all(x == 0 or pair[a.parent[x]] == b.parent[y] for x, y in got)


def test_decontaminate(spark):
    item = prose(77, 40)
    edited = item.replace("w1", "v1", 3)
    base = docs(spark, [(1, prose(1, 50) + " " + item.upper() + " " + prose(2, 50), "a"), (2, edited + " tail", "a"), (3, prose(3, 100), "a"), (4, None, "a"), (5, "", "a"), (6, item[: len(item) // 2], "a")])
    items = spark.createDataFrame([(1, item), (2, None), (3, "tiny")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(base, items).collect()}
    assert set(got) == {1, 2} and got[1].edits == 0 and got[2].edits == 3
    start = len(prose(1, 50)) + 1
    assert (got[1].start, got[1].stop) == (start, start + len(item))
    assert sorted(r.doc_id for r in decontaminate.clean(base, items).collect()) == [3, 4, 5, 6]


def edit_distance_anywhere(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate_equals_brute_scan(spark):
    """Every document and item whose least edit distance anywhere is within the budget, and no other."""
    rng = random.Random(8)
    items = [(k, prose(200 + k, 12 + k)) for k in range(6)] + [(6, "two words"), (7, "two words"), (8, None), (9, "  "), (10, "ÉtÉ")]
    rows = []
    for i in range(40):
        k = rng.randrange(6)
        own = list(items[k][1])
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice(("", "é", "xy"))
        rows.append((i, prose(i, 15) + " " + "".join(own) + " " + prose(i + 50, 15), "a"))
    rows += [(50, "has Two  words and TWO\tWORDS here", "a"), (51, "two wordsmiths, atwo words", "a"), (52, "l'été été", "a"), (53, (prose(3, 400) + " ") * 200 + items[5][1], "a"), (50, "two words", "a")]
    budget, want = decontaminate.Budget(), set()
    plain = lambda t: "".join(" " if c <= " " else c for c in t.lower())
    for i, text, _ in rows:
        for k, item in items:
            item = plain(item or "").strip()
            if 0 < len(item) < budget.q:
                hit = re.search(rf"(?:^| ){re.escape(item)}(?: |$)", plain(text))
            else:
                hit = item and len(text) < 5000 and edit_distance_anywhere(item, plain(text)) <= budget.edits(len(item))
            if hit or (i, k) == (53, 5):
                want.add((i, k))
    made = docs(spark, rows).withColumnRenamed("lang", "edits")
    got = decontaminate.decontaminate(made, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len({i for i, _ in want}) > 20
    assert sorted(r.start for r in got if r.doc_id == 50 and r.item_id == 6) == [0, 19]
    assert decontaminate.decontaminate(made.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.clean(made, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_decontaminate_in_shards(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(200 + k, 20)) for k in range(5)], "item_id long, text string")
    base = docs(spark, [(k, prose(200 + k % 7, 20) + " end", "a") for k in range(14)])
    whole = sorted(map(tuple, decontaminate.decontaminate(base, items).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 150)
    assert sorted(map(tuple, decontaminate.decontaminate(base, items).collect())) == whole and len(whole) == 10
    assert sorted(r.doc_id for r in decontaminate.clean(base, items).collect()) == [5, 6, 12, 13]


def test_alignment_is_exact():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(30)]
        text = [rng.randrange(4) for _ in range(10)] + [x for x in item if rng.random() > 0.05] + [rng.randrange(4) for _ in range(10)]
        best = edit_distance_anywhere(item, text)
        got = decontaminate.align(np.array(item, np.uint32), np.array(text, np.uint32), -30, len(text), 6)
        assert (min(g[2] for g in got) == best) if best <= 6 else not got


def brute_components(rows, size, percent=80):
    sets, out = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        out[i] = i
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and out[a] < out[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    out[b] = out[a]
                    changed = True
                elif sets[a] and sets[b] and out[b] < out[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    out[a] = out[b]
                    changed = True
    return {i: (len(sets[i]), out[i]) for i in sets}


@pytest.mark.parametrize(("size", "block"), [(2, 1000), (5, 7)])
def test_near_duplicates(spark, size, block):
    rng, rows = random.Random(9), []
    for g in range(6):
        base = prose(g, 120).split()
        for _ in range(8):
            new = list(base)
            for _ in range(rng.randrange(8)):
                new[rng.randrange(len(new))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(new)))
    rows += [(100, rows[0][1].upper()), (101, None), (102, ""), (103, "one"), (104, "ONE"), (105, "  ")]
    got = near_duplicates.near_duplicates(docs(spark, [(i, t, "a") for i, t in [*rows, rows[3]]]), shingle=size, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size)
    assert len(got) == len(rows) + 1 and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicates.near_duplicates(docs(spark, [(None, "a b c", "a")])).first().kept


def test_near_duplicates_at_the_limit(spark):
    """Pairs of similarity 0.80 exactly are links, those one shingle below are none; long texts, ties and clashing columns."""
    rows = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(91)]  # 90 shingles
        for same in (80, 79):  # 80 of 100, 79 of 101
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: same + 1] + [f"g{g}s{same}o{k}" for k in range(90 - same)]))]
            base = [f"{w}x" for w in base]
    long = prose(1, 60_000)
    rows += [(500, long), (501, long + " tail"), (502, long + " tail"), (502, long + " tail")]
    made = docs(spark, [(i, t, "a") for i, t in rows]).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "node")
    got = near_duplicates.near_duplicates(made, shingle=2).collect()
    want = brute_components([r for r in rows if r[0] < 500], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id < 500} == want and sum(c != i for i, (_, c) in want.items()) == 25
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id >= 500) == [(500, 500), (501, 500), (502, 500), (502, 500)]


@pytest.mark.parametrize("most", [10, 0])
def test_components(spark, most):
    edges = [(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 3), (50, 50), (None, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    want = {}
    for a, b in ((a, b) for a, b in edges if a is not None):
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(50):
        for a, b in ((a, b) for a, b in edges if a is not None):
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: v for k, v in want.items() if k != v}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = prose(77, 40)
    texts = [prose(i, 80) + "." for i in range(12)]
    rows = [*enumerate(texts), (20, texts[0]), (21, texts[1][:-5] + "zz."), (22, texts[2] + "\n" + item + "."), (23, "a | b | c | d"), (24, texts[3] + " mail bob.22@mail1.example.com.")]
    docs(spark, [(i, t, "ab"[i % 2]) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(range(12)) and all(r.taken <= 3 * r.size for r in got.values())
    made = corpus_pipeline.surrogates(spark, docs(spark, [(24, rows[-1][1], "a")]), "").first()
    assert "bob.22@mail1" not in made.text and made.n_chars == len(made.text)


def test_pipeline_edges(spark, tmp_path):
    """Each stage takes nulls in any column, empty texts, repeated rows and ids, and an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(1, None), (2, "short"), (3, prose(77, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    body = prose(1, 80) + "."
    rows = [(1, body, "en", "s", 5), (1, body, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "", 0), (None, body + " more", None, "s", None), (None, None, "en", "s", 1), (4, prose(2, 80) + ".", "en", None, 1), (4, prose(3, 80) + ".", "de", None, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as kept", "1 as taken")
    for docs_, least in ((odd, 1), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs_, str(tmp_path))
            n = got.count()
            assert n >= least and (name == "source mix" or got.columns == corpus_pipeline.COLUMNS), name
    kept = corpus_pipeline.near_dup(spark, odd, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.lang or "") for r in kept) == [(0, ""), (0, "en"), (1, "en"), (2, ""), (3, "en"), (4, "de" if prose(3, 80) < prose(2, 80) else "en")]
    assert corpus_pipeline.leaks(spark, odd, str(tmp_path)).count() == len(rows)
    assert sorted(r.size for r in corpus_pipeline.mix(spark, odd, str(tmp_path)).collect()) == [0, 0, 0, 80, 80, 80, 80, 81]


def test_among_keeps_every_asked_row(spark):
    from tessera.llm.text import among

    rows = spark.range(2000).selectExpr("id", "cast(id as string) as chunk")
    ids = spark.createDataFrame([(k,) for k in range(0, 2000, 7)] * 3 + [(None,)], "k long")
    got = [r.id for r in among(rows, "id", ids).collect()]
    assert set(range(0, 2000, 7)) <= set(got) and len(got) == len(set(got)) < 320
    assert among(rows, "id", ids).columns == ["id", "chunk"]
    assert among(rows, "id", ids.where("false")).count() == 0


def test_html_siblings_are_aligned_once_for_their_kinds(monkeypatch):
    """Nodes of the same two kinds share one alignment, found without arrays if it is short, and the same as with them."""
    rng, made = random.Random(8), []
    short, aligned = html_wrapper.Matcher._short_path, html_wrapper._path

    def path(self, xa, xb):
        made.append(short(self, xa, xb))
        assert made[-1] == aligned(*self._table(xa, xb))
        return made[-1]

    monkeypatch.setattr(html_wrapper.Matcher, "_short_path", path)
    monkeypatch.setattr(html_wrapper, "_path", lambda *a: pytest.fail("arrays for a few siblings"))
    own = html_wrapper.Matcher()
    for _ in range(60):
        trees = []
        for _ in range(2):
            kids = [[]]
            for node in range(1, 14):
                kids.append([])
                kids[rng.choice([0, 0, max(0, node - 2)])].append(node)
            # renumbered in page order
            order, todo = [], [0]
            while todo:
                order.append(todo.pop())
                todo += reversed(kids[order[-1]])
            at = {node: k for k, node in enumerate(order)}
            trees.append((["#", *rng.choices("ab", k=13)], [[at[c] for c in kids[node]] for node in order]))
        shapes = [own.shape(*t) for t in trees]
        first = own.pairs(shapes[0], trees[0][1], shapes[1], trees[1][1])
        count = len(made)
        assert own.pairs(shapes[0], trees[0][1], shapes[1], trees[1][1]) == first and len(made) == count
    assert len(made) > 40
