"""License scans by sentence rules.

A text is cut into sentences at punctuation and paragraphs; single line breaks may end a
sentence or stand inside it, so that a known sentence is found on its own lines and also
wrapped, wherever in the text. Sentences are normalised: lower case, and one blank for
whatever is no letter or digit. Known sentences become identifiers, others are passed over;
one with a break inside is known by all of its parts in a row. Rules are ordered sequences
of identifiers; where several fit, the longest does, and matches don't overlap.

All of it is one projection without a shuffle. Texts without any word of TRIGGERS, one of
which is in every known sentence, are not cut at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Flat

# Sentences of public licences, and the licences that sequences of them stand for.
SENTENCES = {
    "mit_line": "Released under the MIT License.",
    "mit_line2": "This project is licensed under the MIT License.",
    "mit_line3": "Licensed under the MIT License.",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc_warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "apache_line": "Licensed under the Apache License, Version 2.0.",
    "apache_line2": "This project is licensed under the Apache License, Version 2.0.",
    "apache_header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gnu_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gnu_hope2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl_received": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl_received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2_terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl11_terms": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "epl1_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "epl2_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "epl2_terms2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "bsl_terms": "Distributed under the Boost Software License, Version 1.0.",
    "bsl_grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_altered": "This notice may not be removed or altered from any source distribution.",
    "cc0_work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0_line": "This work is licensed under CC0 1.0 Universal.",
    "ccbync_line": "Licensed under CC BY-NC 4.0.",
    "ccbync_work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbysa_line": "Licensed under CC BY-SA 4.0.",
    "ccbysa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbysa3_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "ccby_line": "Licensed under CC BY 4.0.",
    "ccby_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccby3_work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "artistic2": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
}
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_line"]),
    ("MIT", ["mit_line2"]),
    ("MIT", ["mit_line3"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["zero_grant", "isc_warranty"]),
    ("0BSD", ["zero_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD", ["bsd_line"]),
    ("Apache-2.0", ["apache_line"]),
    ("Apache-2.0", ["apache_line2"]),
    ("Apache-2.0", ["apache_header", "apache_use", "apache_copy", "apache_basis", "apache_see"]),
    ("Apache-2.0", ["apache_header", "apache_use", "apache_copy"]),
    ("Apache-2.0", ["apache_header", "apache_use"]),
    ("MPL-2.0", ["mpl2_terms", "mpl2_copy"]),
    ("MPL-2.0", ["mpl2_terms"]),
    ("MPL-1.1", ["mpl11_terms", "apache_use"]),
    ("MPL-1.1", ["mpl11_terms"]),
    ("EPL-1.0", ["epl1_terms"]),
    ("EPL-2.0", ["epl2_terms"]),
    ("EPL-2.0", ["epl2_terms2"]),
    ("BSL-1.0", ["bsl_terms"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("Zlib", ["zlib_warranty", "zlib_grant", "zlib_altered"]),
    ("Zlib", ["zlib_warranty", "zlib_grant"]),
    ("CC0-1.0", ["cc0_work"]),
    ("CC0-1.0", ["cc0_line"]),
    ("CC-BY-NC-4.0", ["ccbync_line"]),
    ("CC-BY-NC-4.0", ["ccbync_work"]),
    ("CC-BY-SA-4.0", ["ccbysa_line"]),
    ("CC-BY-SA-4.0", ["ccbysa_work"]),
    ("CC-BY-SA-3.0", ["ccbysa3_work"]),
    ("CC-BY-4.0", ["ccby_line"]),
    ("CC-BY-4.0", ["ccby_work"]),
    ("CC-BY-3.0", ["ccby3_work"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
    ("Artistic-2.0", ["artistic2"]),
]
#: Licences of one notice, which differ in title and version; what tells that a copy came along.
GNU = {
    "GPL-2.0": ("GNU General Public License", "2", "gpl_received"),
    "GPL-3.0": ("GNU General Public License", "3", "gpl_received"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1", "lgpl_received"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3", "lgpl_received"),
    "AGPL-3.0": ("GNU Affero General Public License", "3", "agpl_received"),
}
TRIGGERS = "licen|permi|copyright|warrant|redistribut|unencumbered|notice|mpl"


def _gnu() -> None:
    """The notices of the GNU licences: of a program or a library, this version or any later one, and single lines."""
    for name, (title, version, received) in GNU.items():
        free = "{} is free software: you can redistribute it and/or modify it under the terms of the " + title
        by = "as published by the Free Software Foundation"
        for what in ("This program", "This library"):
            forms = [f"{free} {by}{stop} either version {version} of the License, or (at your option) any later version." for stop in (",", ";")]
            forms += [f"{free} {by}{stop} version {version}." for stop in (",", ";")] + [f"{free} version {version} {by}.", f"{free}, version {version}, {by}."]
            for form in forms:
                key = f"gnu{len(SENTENCES)}"
                SENTENCES[key] = form.format(what)
                hope = "gnu_hope2" if what == "This library" else "gnu_hope"
                RULES.extend((name, [key, *more]) for more in ([hope, received], [received], [hope], []))
        for line in ("This work is licensed under the {}, version {}.", "Licensed under the {}, version {}.", "Released under the {}, version {}."):
            key = f"gnu{len(SENTENCES)}"
            SENTENCES[key] = line.format(title, version)
            RULES.append((name, [key]))


def _spdx() -> None:
    """Identifier lines for each licence; the GNU licences' say whether later versions are meant."""
    for name in sorted({name for name, _ in RULES} - {"BSD"}):
        for own in (f"{name}-only", f"{name}-or-later", name) if name in GNU else (name,):
            SENTENCES[f"spdx_{own}"] = f"SPDX-License-Identifier: {own}"
            RULES.append((name, [f"spdx_{own}"]))


_gnu()
_spdx()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a sentence ends; a paragraph's single line breaks are blanks.
BREAK = r"[.!?;:]+[ \t]+|[\r\n]+"
SINGLE = r"(?<![\r\n])\r?\n(?![\r\n])"
# Marks of sentence ends and of single line breaks; lowered texts have no upper case.
END, LINE = "E", "L"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def _identifiers() -> dict[str, str]:
    """name of a sentence -> its identifier, one character."""
    return {name: chr(0xE000 + i) for i, name in enumerate(SENTENCES)}


def _known() -> dict[str, str]:
    """sentence, its parts normalised and joined by END -> its identifier."""
    ids = _identifiers()
    return {END.join(normal(part) for part in re.split(BREAK, s)): ids[name] for name, s in SENTENCES.items()}


def _rules() -> list[tuple[str, str]]:
    """(sequence, licence), the longest first."""
    ids = _identifiers()
    return sorted([("".join(ids[s] for s in rule), name) for name, rule in RULES], key=lambda r: -len(r[0]))


def marked(text: Column) -> Column:
    """The words of a text, with END between sentences and LINE at line breaks inside them."""
    t = F.translate(text, UPPER, LOWER)
    for pattern, mark in (
        (SINGLE, LINE),
        (rf"[.!?;:]+[ \t{LINE}]+|[\r\n]+", END),
        (f"[^a-z0-9{LINE}{END}]+", " "),
        (f" ?{LINE}[ {LINE}]*", LINE),
        (f"[ {LINE}]?{END}[ {LINE}{END}]*", END),
        (f"^[ {LINE}{END}]*|[ {LINE}{END}]*$", END),
    ):
        t = F.regexp_replace(t, pattern, mark)
    return t


def license_columns(text: Column, seq_name: str = "_seq") -> dict[str, Column]:
    known, rules = _known(), _rules()
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # a sentence may start and end at any line; the longest first
    any_ = "|".join(s.replace(" ", f"[ {LINE}]") for s in sorted(known, key=len, reverse=True))
    sentences = F.regexp_extract_all(marked(text), F.lit(f"[{LINE}{END}]({any_})(?=[{LINE}{END}])"), F.lit(1))
    found = F.array_join(F.transform(sentences, lambda s: ids[F.translate(s, LINE, " ")]), "")
    seq = F.when(text.rlike(f"(?i){TRIGGERS}"), found).otherwise(F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    pattern = "|".join(r for r, _ in rules)
    matched = F.regexp_extract_all(F.col("_seq"), F.lit(f"({pattern})"), F.lit(1))
    return {
        "_seq": F.coalesce(seq, F.lit("")),
        "n_known": F.length("_seq").cast("long"),
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform(matched, lambda r: names[r]))), ","),
        "n_unmatched": F.length(F.regexp_replace("_seq", pattern, "")).cast("long"),
    }


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_known sentences, licenses (names, sorted, joined by commas) and n_unmatched, the known sentences that no rule took.

    A null or empty text has none; a long one is scanned wholly. Rows that repeat are scanned each; an
    empty table gives an empty result. Columns of docs with these three names give way, others are kept,
    whatever their names.
    """
    flat = Flat(docs, keys=False)
    added = license_columns(F.col(flat.name(text_col)))
    own = flat.rows.withColumn("_seq", added.pop("_seq"))
    return flat.restored(own, *[c.alias(name) for name, c in added.items()])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document states."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs.select("doc_id", "text")).drop("text")


#: Literal lines, each a licence of its own, counted between ends of sentences or lines; written without the tables above.
OP8_SQL = r"""
WITH lines(licence, line) AS (VALUES
  ('MIT', 'released under the mit license'), ('MIT', 'this project is licensed under the mit license'), ('MIT', 'licensed under the mit license'),
  ('Apache-2.0', 'licensed under the apache license, version 2[.]0'), ('GPL-3.0', 'this work is licensed under the gnu general public license, version 3'),
  ('GPL-2.0', 'this work is licensed under the gnu general public license, version 2'), ('CC-BY-NC-4.0', 'licensed under cc by-nc 4[.]0'),
  ('CC-BY-4.0', 'licensed under cc by 4[.]0'), ('CC-BY-SA-4.0', 'licensed under cc by-sa 4[.]0'), ('Unlicense', 'this is free and unencumbered software released into the public domain'),
  ('MPL-2.0', 'this source code form is subject to the terms of the mozilla public license, v[.] 2[.]0')),
hit AS (SELECT doc_id, chr(10) || regexp_replace(lower(text), '([.!?;:])([ \t\n])', '\1\1\2\2', 'g') || chr(10) AS t FROM documents WHERE regexp_matches(text, '(?i)licen|unencumbered')),
found AS (SELECT doc_id, licence, len(regexp_extract_all(replace(t, chr(10), repeat(chr(10), 4)), '[.!?;:\n][ \t\n]+' || line || '[.!]*[ \t]*\n')) AS n FROM hit CROSS JOIN lines),
by_doc AS (SELECT doc_id, sum(n)::BIGINT AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (n > 0) AS names FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(names, '') AS licenses, 0::BIGINT AS n_unmatched FROM documents LEFT JOIN by_doc USING (doc_id)
"""
