"""The operators made of DataFrame functions only: against plain Python on fixtures and on the smallest tables."""

import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from veldra.llm import chat_format, license_scan, pii, queries, url_filter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in each) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                yield kind, m.start(), m.end()


TEXTS = [
    None,
    "",
    "mail a@b.com.c@d.org x@y, 😀 é b.c+d@e-f.gh-i.j end",
    "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 0001.02.3.4 v1.2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 5 and 12",
    "phone +1 (366) 555-9807 +12 +123456789012345678",
    "9" * 4000 + "." + "1" * 3000 + " x",
    "a" * 4000 + " b@c.de",
    "password=3f3a9c1d77e2 token: \"abcd1234efgh\" john [at] mail [dot] com",
    "card 4111 1111 1111 1111 again",
    "card 4111 1111 1111 1111 again",
]


def test_pii_base_spans_match_the_plain_patterns(spark, sf_dir):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, candidates string")
    model = pii.train(docs)
    for r in pii.detect(docs, model).collect():
        expected = list(base_spans(TEXTS[r.doc_id] or ""))
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == expected, r.doc_id
    big = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, sf_dir).collect():
        spans = list(base_spans(big[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_pii_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "write a@b.com or +1 (366) 555-9807."), (2, None)], "doc_id long, text string")
    model = pii.fit([])
    made = pii.detect(docs, model)
    texts = {r.doc_id: r.t for r in made.select("doc_id", pii.redact(made.text, made.pii).alias("t")).collect()}
    assert texts == {1: "write [EMAIL] or [PHONE].", 2: None}
    assert pii.detect(docs.where("false"), pii.train(docs.where("false"))).count() == 0


def test_em_trusts_the_better_labeler():
    pats = [("email", [1, 1, 0, 1], [2, 1, 0], 90), ("email", [-1, 0, 0, -1], [1, 1, 0], 40), ("email", [1, -1, 0, 1], [2, 1, 0], 10)]
    model = pii.fit(pats)
    assert min(model.reliability["email"][0], model.reliability["email"][3]) >= model.reliability["email"][1]


def test_pii_added_spans_are_right(spark):
    """Planted hidden mail addresses and secrets among look-alikes: precision and recall of what the method adds."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijkmnpqrstuvwxyz", k=n))
    key = lambda: "".join(rng.choices("abcdef0123456789", k=20))
    rows, planted = [], set()
    for i in range(400):
        mail, secret = f"{word(6)} [at] {word(7)} [dot] {rng.choice(['com', 'org', 'de'])}", key()
        before, value = rng.choice([("please write to ", mail), ("contact: ", mail), ("user login password=", secret), ("auth token: ", secret), ("credential api_key = ", secret), ("", "")])
        near = rng.choice(["the token: ring", "meet us [at] noon", "a secret = ", "version 1.2.3.400 of it", "order 12 and 13", "plain words"])
        head = f"{word(5)} {word(4)} "
        text = f"{head}{before}{value} {word(5)}. {near} {word(4)}"
        rows.append((i, text))
        if value:
            planted.add((i, len(head + before), len(head + before + value)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {(r.doc_id, s.start, s.end) for r in pii.detect(docs, pii.train(docs)).collect() for s in r.pii if not s.base}
    assert len(planted) > 250
    assert len(added & planted) / len(added) > 0.9 and len(added & planted) / len(planted) > 0.9


def test_pii_country_codes_need_no_separator(spark):
    texts = ["+14155550100", "+1 4155550100", "+44 20 7946 0000", "+2101234567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    votes = [r.candidates[-1].votes[1] for r in pii.with_candidates(docs).orderBy("doc_id").collect()]
    assert votes == [1, 1, 1, -1]


def test_chat_round_trip(spark):
    nasty = ["", "\\", "<next>", "a\\[b<", "</turn>\n<turn:assistant>x", "\\\\<\\>", queries.TRICKY, None]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(nasty)] + [(None, 0, None, None), (2, 1, "a>b<\\", "x"), (2, 1, "a>b<\\", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[:8]]
    assert back[1].learned == [t or "" for i, t in enumerate(nasty) if i % 3]
    assert [(t.role, t.text) for t in back[2].turns] == [("a>b<\\", "x")] * 2
    assert back[1].formatted.count("<turn:") == 6 and [(t.role, t.text) for t in back[None].turns] == [("", "")]
    assert chat_format.format_chats(turns.where("false")).count() == 0


def scan_plain(text):
    known = license_scan.known_sentences()
    ids = [known[n] for s in re.split(license_scan.BREAK, text or "") if (n := license_scan.normal(s)) in known]
    slots: list = list(ids)
    for name, seq in license_scan.RULES:
        i = 0
        while i + len(seq) <= len(slots):
            if slots[i : i + len(seq)] == seq:
                slots[i : i + len(seq)] = [(name,)]
            i += 1
    return ids, [x[0] for x in slots if isinstance(x, tuple)]


def test_license_rules_against_plain_python(spark, sf_dir):
    mit = " ".join(license_scan.SENTENCES[k][0] for k in ("mit_grant", "mit_notice", "as_is"))
    texts = [None, "", "MIT License\n" + mit, "x. " + mit + "\nReleased under the MIT License. foo", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "licence license."]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licenses", url_filter.F.lit(1))
    some = 0
    for r in license_scan.scan(docs).collect():
        assert (r.sentences, r.licenses) == scan_plain(texts[r.doc_id]), r.doc_id
        some += bool(r.licenses)
    assert some > 4
    assert license_scan.scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="known sentence"):
        license_scan.known_sentences({"x": ["No such word."]})


HEADERS = [
    ("MIT", """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""),
    ("Apache-2.0", """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""),
]
WHOLE = {"MIT": ["mit_title", "mit_grant", "mit_notice", "as_is"], "Apache-2.0": ["apache_ref", "apache_use", "apache_copy", "apache_basis"], "GPL-3.0-or-later": ["gpl_free", "gpl_hope"], "MPL-2.0": ["mpl_ref"], "BSD-3-Clause": ["bsd_grant", "bsd_keep", "bsd_binary", "bsd_endorse"], "BSD-2-Clause": ["bsd_grant", "bsd_keep", "bsd_binary"]}


def test_each_license_sentence_is_found_in_one_line_and_wrapped(spark):
    cases = [(i, s) for i, each in license_scan.SENTENCES.items() for s in each]
    wraps = [lambda s: s, lambda s: f"So it is. {s} And more.", *[lambda s, w=w, c=c: "\n".join(c + x for x in textwrap.wrap(s, w, break_on_hyphens=False, break_long_words=False)) for w in (12, 30, 72) for c in ("", " * ", "# ")], lambda s: s.replace(" ", "\r\n")]
    rows = [(n, k, w(s)) for n, (_, s) in enumerate(cases) for k, w in enumerate(wraps) if k != 1 or s[-1] in ".;:"]
    found = license_scan.scan(spark.createDataFrame([(f"{n} {k}", t) for n, k, t in rows], "doc_id string, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.sentences == [cases[int(r.doc_id.split()[0])][0]], r
    no = ["Permission is hereby granted, free of charge,\nto no person.", "as the MIT License\nsays", "MIT\nLicenses", "v. 2.0. Mozilla Public License"]
    assert not any(r.sentences for r in license_scan.scan(spark.createDataFrame(list(enumerate(no)), "doc_id long, text string")).collect())


def test_wrapped_license_headers(spark):
    comments = ["{}", "# {}", " * {}", "// {}", "    {}"]
    rows = [(name, "\n".join(c.format(x) for x in text.split("\n"))) for name, text in HEADERS for c in comments]
    rows += [(name, text.replace("\n", "\r\n")) for name, text in HEADERS]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for r in found:
        assert (r.sentences, r.licenses) == (WHOLE[r.doc_id], [r.doc_id]), r
    assert len(found) == len(rows)


def test_each_license_rule_fires_on_its_own_wrapped_text(spark):
    rows = []
    for n, (_, sequence) in enumerate(license_scan.RULES):
        own = ["\n".join(" * " + x for x in textwrap.wrap(license_scan.SENTENCES[i][-1], 76, break_on_hyphens=False, break_long_words=False)) for i in sequence]
        rows.append((n, "Copyright 2020 A. Author\n" + "\n *\n".join(own) + "\nint main(void) { return 0; }"))
    found = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {n: [name] for n, (name, _) in enumerate(license_scan.RULES)}


def judge_plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules_against_plain_python(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block"), ("a.example.net", "/en/x", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/xy?q", "http://example.net/en/", "http://xexample.net/en/", "ftp://b.a.example.net", "http://net/", "http://net", "http://x.org/fr/1#a", "http://org/fr", "http://\u0001.net/é", "a://b.net:80/://c", "http://..net//"]
    urls += ["http://hot.example.net/en/1"] * 50
    pages = spark.createDataFrame([(i, u, "host?") for i, u in enumerate(urls)], "page_id long, url string, host string")
    made = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=5)
    clean = [(h, p, "block" if (h, p) == ("org", "/fr/") else v) for h, p, v in rules if h]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert got == {i: judge_plain(u, clean, "allow") for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.where("false"), made.select("host", "path", "verdict")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}


def test_redaction_leaves_nothing_of_overlapping_spans(spark):
    rng = random.Random(8)
    rows = [(0, "host 10.0.0.4 111 1111 1111 1111 end"), (1, "+49 10.0.0.4 111 1111 1111 1111 x"), (2, "password=a1@b2c3d4.example.com 4111 1111 1111 1111")]
    bits = ["10.0.0.4", " 4111 1111 1111 1111", "+49 171 5550 123", " a.b@c-d.org", " password=abc123def", ".", " ", "1", "x ", "word " * 300, "é😀"]
    rows += [(i, "".join(rng.choices(bits, k=rng.choice([2, 6, 30])))) for i in range(3, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    made = pii.detect(docs, pii.train(docs))
    got = made.select("doc_id", "text", "pii", "found", pii.redact(F.col("text"), F.col("pii")).alias("out")).collect()
    assert got[0].out == "host [IP] end"
    for r in got:
        covered, want, at = set(), [], 0
        for s in sorted(r.pii, key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                want += [r.text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
            assert s.base or not any(b.base and b.start < s.end and s.start < b.end for b in r.pii)
        assert r.out == "".join(want) + r.text[at:] and r.found == 1
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == list(base_spans(r.text))


def test_many_matches_in_one_text_take_seconds(spark):
    import time

    text = "a@b.co " * 100_000
    docs = spark.createDataFrame([(1, text), (2, "card 4111 1111 1111 1111, token=abcdef123456; " * 20_000)], "doc_id long, text string")
    model = pii.fit([])
    pii.detect(docs.limit(0), model).count()
    began = time.perf_counter()
    made = pii.detect(docs, model)
    got = made.select("doc_id", F.size("pii").alias("n"), F.length(pii.redact(F.col("text"), F.col("pii"))).alias("chars")).collect()
    took = time.perf_counter() - began
    assert {r.doc_id: (r.n, r.chars) for r in got}[1] == (100_000, 800_000)
    assert took < 60, took


BSD = """Copyright (c) 2010, The Regents of the University
{0}Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{1} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{2} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """{3} Neither the name of the University of California, Berkeley nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""


def test_license_texts_with_names_marks_expressions_and_titles(spark):
    """Texts and answers written down here, without the module's own splitter."""
    marks = [("", "1.", "2.", "3."), ("", "(1)", "(2)", "(3)"), ("", "a)", "b)", "c)"), ("", " *", " *", " *"), ("# ", "#  (i)", "#  (ii)", "#  (iii)")]
    cases = {f"bsd3 {m[1]}": ((BSD + ENDORSE).format(*m), ["BSD-3-Clause"]) for m in marks}
    cases |= {f"bsd2 {m[1]}": (BSD.format(*m), ["BSD-2-Clause"]) for m in marks}
    cases |= {
        "author": (BSD.format("", "1.", "2.") + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        "or": ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nfn main() {}", ["MIT", "Apache-2.0"]),
        "and": ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note AND (BSD-2-Clause or ISC) */ int x;", ["GPL-2.0-only", "BSD-2-Clause", "ISC"]),
        "one": ("# SPDX-License-Identifier: MIT\nAND then some more words", ["MIT"]),
        "unknown": ("# SPDX-License-Identifier: NoSuch-1.0 OR MIT", ["MIT"]),
        "gpl": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", ["GPL-3.0-only"]),
        "apache": ("\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", ["Apache-2.0"]),
        "mpl": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
        "go": ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", ["BSD-style"]),
        "none": ("The University (1) may use a) this software license b) or permission.", []),
        "far": ("Neither the name of " + "word " * 40 + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", []),
    }
    found = license_scan.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in found} == {k: want for k, (_, want) in cases.items()}


def test_license_scan_keeps_null_ids_and_long_texts(spark):
    rows = [(None, "MIT License"), (None, None), (1, "license " * 200_000), (2, "license (a) " * 50_000 + "\nMIT License")]
    got = {(r.doc_id, tuple(r.licenses)) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, ("MIT",)), (None, ()), (1, ()), (2, ("MIT",))}
