"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into pieces at line breaks and ends of sentences; each is normalised (lower case, letters and digits with
single spaces). A known licence sentence is found where one piece or several, one after another, make up its words, so a
notice may be wrapped over lines, stand in a comment, or hold such breaks itself; from the left, the longest counts. Where a
known sentence has ``{}``, up to ``SLOT`` words may stand, as names of holders do; marks of lists before a sentence don't
count; an SPDX tag with an expression counts as one tag for each licence that it names. The ids
found, in order, are matched against ordered licence rules. A rule is a sequence of sentence ids that must stand one after
another among a text's known sentences; rules are tried in their order (the longer first), and a sentence that one rule has
used is not used by a later one.

Texts are only normalised if they hold a trigger, a part that each known sentence has, so a text without triggers costs one
search. That loses nothing: a known sentence without a trigger is refused when the table is built.

Defined cases: null and empty texts have no licence; a repeated notice counts each time; extra columns are ignored;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known licence sentences (normalised by ``normal`` before use)
SENTENCES = {
    "mit_title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit_ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit_grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit_notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    ],
    "as_is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "apache_ref": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Released under the Apache License, Version 2.0.",
    ],
    "apache_use": ["you may not use this file except in compliance with the License."],
    "apache_copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache_basis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "gpl3_ref": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
    ],
    "gpl2_ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "gpl_free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl_hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "lgpl_ref": ["Licensed under the GNU Lesser General Public License, version 3."],
    "bsd3_ref": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "bsd2_ref": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd_grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ],
    "bsd_keep": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd_endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the names of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
        "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd_style": ["Use of this source code is governed by a BSD-style license that can be found in {} file."],
    "isc_grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "gpl2_free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "agpl_free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "lgpl_free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "lgpl_hope": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib_grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "bsl_grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "epl_ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cc0_ref": ["Licensed under CC0 1.0.", "This work is licensed under CC0 1.0."],
    "ccbync_ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "ccby_ref": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "ccbysa_ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "gpl3_title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2_title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3_title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21_title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3_title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache_title": ["Apache License Version 2.0, January 2004"],
    "mpl_title": ["Mozilla Public License Version 2.0"],
    "epl_title": ["Eclipse Public License - v 2.0"],
    "ccby_title": ["Creative Commons Attribution 4.0 International Public License"],
    "ccbysa_title": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "ccbync_title": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "mpl_ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx_{name}": [f"SPDX-License-Identifier: {name}"] for name in SPDX}
# fixed values: licence rules in the order in which they are tried
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_notice", "as_is"]),
    ("Apache-2.0", ["apache_ref", "apache_use", "apache_copy", "apache_basis"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_keep", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_keep", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl_hope"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_keep"]),  # what both have, cut off before the clause that tells them apart
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("MIT", ["mit_title", "mit_grant"]),
    ("MIT", ["mit_grant"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("AGPL-3.0-or-later", ["agpl_free"]),
    ("LGPL-2.1-or-later", ["lgpl_free"]),
    ("ISC", ["isc_grant"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib_grant"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("EPL-2.0", ["epl_ref"]),
    ("CC0-1.0", ["cc0_ref"]),
    ("MIT", ["mit_ref"]),
    ("Apache-2.0", ["apache_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("GPL-2.0-only", ["gpl2_ref"]),
    ("LGPL-3.0-only", ["lgpl_ref"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("CC-BY-NC-4.0", ["ccbync_ref"]),
    ("CC-BY-4.0", ["ccby_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa_ref"]),
    ("MPL-2.0", ["mpl_ref"]),
    ("MIT", ["mit_title"]),
    ("GPL-3.0-only", ["gpl3_title"]),
    ("GPL-2.0-only", ["gpl2_title"]),
    ("LGPL-3.0-only", ["lgpl3_title"]),
    ("LGPL-2.1-only", ["lgpl21_title"]),
    ("AGPL-3.0-only", ["agpl3_title"]),
    ("Apache-2.0", ["apache_title"]),
    ("MPL-2.0", ["mpl_title"]),
    ("EPL-2.0", ["epl_title"]),
    ("CC-BY-4.0", ["ccby_title"]),
    ("CC-BY-SA-4.0", ["ccbysa_title"]),
    ("CC-BY-NC-4.0", ["ccbync_title"]),
    ("BSD-style", ["bsd_style"]),
    *((name, [f"spdx_{name}"]) for name in SPDX),
]
TRIGGERS = ("licen", "warrant", "permission", "redistribut", "unencumbered")
BREAK = r"(?<=[.!?;:])\s+|[\n\r]+"
SLOT = 12
#: ``(1)``, ``a)`` or ``iv)`` at the beginning of a line or after a sentence
MARK = r"(?m)(?:^|(?<=[.!?;:]\s))[^\S\n\r]*[*#/;%-]{0,3}[^\S\n\r]*\(?(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})\)[^\S\n\r]+"
#: a tag and the first licence of its expression, or the next licence of it
TAG = r"(?i)(?:SPDX-License-Identifier:[ \t]*|(?<!^)\G[ \t]*\)*[ \t]*(?:OR|AND)[ \t]+)\(*[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)(?:[ \t]+WITH[ \t]+[A-Za-z0-9.-]+)?"


def normal(sentence: str) -> str:
    """Lower case; whatever is no ASCII letter, digit or non-ASCII character separates words by one space."""
    return " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in sentence.lower()).split())


def normal_pieces(text: Column) -> Column:
    """The normalised pieces of a text that hold words, each between two newlines."""
    plain = F.regexp_replace(F.regexp_replace(text, TAG, "\nSPDX-License-Identifier: $1\n"), MARK, "\n")
    words = F.regexp_replace(F.lower(F.regexp_replace(plain, BREAK, "\n")), r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), r" *\n[ \n]*", "\n")


def known_sentences(table: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    known = {normal(s): i for i, each in table.items() for s in each}
    for s in known:
        if not any(t in s for t in TRIGGERS):
            raise ValueError(f"a known sentence needs one of {TRIGGERS}: {s}")
    return known


def filled(table: dict[str, list[str]] = SENTENCES) -> list[tuple[str, str]]:
    """(pattern, sentence without its slots) of each known sentence that has some."""
    out = []
    for s in [s for each in table.values() for s in each if "{}" in s]:
        parts = [normal(p).replace(" ", "[ \n]") for p in s.split("{}")]
        out.append(("(?<=\n)" + (f"[ \n](?:[^ \n]+[ \n]){{1,{SLOT}}}?").join(parts) + "(?=\n)", normal(s)))
    return out


def sentence_ids(text: Column, known: dict[str, str], slots: list[tuple[str, str]] = ()) -> Column:
    """The ids of the known sentences of a text, in order."""
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    longest_first = sorted(known, key=lambda s: -len(s))
    pattern = "(?<=\n)(?:" + "|".join(s.replace(" ", "[ \n]") for s in longest_first) + ")(?=\n)"
    pieces = normal_pieces(text)
    for slotted, bare in slots:
        pieces = F.regexp_replace(pieces, slotted, bare)
    found = F.regexp_extract_all(pieces, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.element_at(F.create_map(*pairs), F.translate(s, "\n", " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(id, sentences array<string>, licenses array<string>): licences in the order of their first sentences.

    The id sequence is written as ``|0:a|1:b|``-like text (here: `` a  b ``); each rule replaces its sequence by its
    number, in the rules' order, so that what remains are the rules that apply, in text order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = known_sentences(table)
    none = F.array().cast("array<string>")
    hit = text.rlike("(?i)" + "|".join(TRIGGERS))
    found = docs.select(F.col(id_col), F.when(hit, sentence_ids(text, known, filled(table))).otherwise(none).alias("sentences"))
    line = F.concat(F.lit(" "), F.array_join("sentences", "  "), F.lit(" "))
    for n, (_, sequence) in enumerate(rules):
        line = F.replace(line, F.lit(" " + "  ".join(sequence) + " "), F.lit(f" #{n} "))
    left = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x.startswith("#"))
    names = F.array(*[F.lit(name) for name, _ in rules])
    licenses = F.transform(left, lambda x: F.element_at(names, F.substring(x, F.lit(2), F.lit(9)).cast("int") + 1))
    return found.withColumn("licenses", F.when(F.size("sentences") > 0, licenses).otherwise(none))
