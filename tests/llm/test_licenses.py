import re

import pytest

from sparkpact.llm.licenses import RULES, SENTENCES, TRIGGERS, license_scan, normal, op8_license_scan

from ..oracle import agree

MIT = " ".join(SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_warranty"))
BSD2 = "\n".join(SENTENCES[k] for k in ("bsd_grant", "bsd_source", "bsd_binary"))


def test_every_sentence_has_a_trigger():
    assert all(re.search(TRIGGERS, normal(s)) for s in SENTENCES.values())
    assert {s for _, rule in RULES for s in rule} == set(SENTENCES)


@pytest.fixture(scope="module")
def found(spark):
    wrapped = re.sub(r"(.{40}\S*) ", r"\1\n", MIT)
    texts = {
        "none": "Plain words.", "null": None, "empty": "", "line": "Foo bar.\nReleased under the MIT License.\nMore", "case": "released UNDER the mit license!",
        "two": "Licensed under CC BY-NC 4.0.\nx\nLicensed under the Apache License, Version 2.0.", "twice": "Released under the MIT License.\nReleased under the MIT License.",
        "inside": "It was not released under the MIT License.", "mit": MIT, "wrapped": wrapped, "bsd2": BSD2, "bsd3": BSD2 + "\n" + SENTENCES["bsd_name"],
        "order": "\n".join(SENTENCES[k] for k in ("bsd_binary", "bsd_grant", "bsd_source")), "stray": SENTENCES["mit_notice"], "between": BSD2.replace("\n", "\nOther text.\n"),
        "long": "word " * 50000 + "\nReleased under the MIT License.\n" + "tail " * 1000,
    }
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in texts.items()], "k string, text string, licenses string, _seq string")
    return {r["k"]: (r["n_known"], r["licenses"], r["n_unmatched"]) for r in license_scan(df).collect()}


@pytest.mark.parametrize(
    ("k", "want"),
    [
        ("none", (0, "", 0)), ("null", (0, "", 0)), ("empty", (0, "", 0)), ("line", (1, "MIT", 0)), ("case", (1, "MIT", 0)), ("two", (2, "Apache-2.0,CC-BY-NC-4.0", 0)),
        ("twice", (2, "MIT", 0)), ("inside", (0, "", 0)), ("mit", (3, "MIT", 0)), ("wrapped", (3, "MIT", 0)), ("bsd2", (3, "BSD-2-Clause", 0)), ("bsd3", (4, "BSD-3-Clause", 0)),
        ("order", (3, "", 3)), ("stray", (1, "", 1)), ("between", (3, "BSD-2-Clause", 0)), ("long", (1, "MIT", 0)),
    ],
)
def test_scan(found, k, want):
    assert found[k] == want


def test_empty(no_docs):
    assert license_scan(no_docs).collect() == []


def test_query(spark, sf_dir):
    from sparkpact.llm.entries import ORACLE_SQL

    agree(op8_license_scan(spark, sf_dir), ORACLE_SQL["op8_license_scan"], sf_dir)


GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [(r["n_known"], r["licenses"], r["n_unmatched"]) for r in license_scan(df).orderBy("k").collect()]


def test_sentences_with_breaks_are_compared_whole(spark):
    gpl3, mpl = GPL2.replace("version 2", "version 3").replace("Foundation; ", "Foundation, ").replace("software; ", "software: "), SENTENCES["mpl2_terms"]
    wrap = lambda t: re.sub(r"(.{40}\S*) ", r"\1\n", t)
    no = [gpl3.replace("version 3", "version 9"), gpl3.replace("GNU General", "GNU Public"), "This program is free software. All rights reserved; no license is granted."]
    no += ["This program is free software. It may be redistributed.", mpl.replace("2.0", "1.9"), mpl.replace("v. 2.0", "v. x. 2.0"), "MIT Licensed plugins", "SPDX-License-Identifier: Other-1.0"]
    assert scanned(spark, no) == [(0, "", 0)] * len(no)
    other = [GPL2, wrap(GPL2), gpl3.replace("GNU General", "GNU Lesser General"), gpl3.replace("GNU General", "GNU Affero General"), gpl3.replace("version 3", "version 2")]
    other += [gpl3.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: AGPL-3.0-only\n"]
    assert [x[1] for x in scanned(spark, other)] == ["GPL-2.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-2.1", "AGPL-3.0"]
    yes = [gpl3, wrap(gpl3), gpl3 + " " + SENTENCES["gpl_received"], gpl3.replace("software: ", "software:\r\n")]
    assert scanned(spark, yes) == [(1, "GPL-3.0", 0), (1, "GPL-3.0", 0), (2, "GPL-3.0", 0), (1, "GPL-3.0", 0)]
    assert scanned(spark, [mpl, mpl.replace("v. ", "v.\n"), mpl + " If a copy"]) == [(1, "MPL-2.0", 0)] * 3


def test_each_licence_is_found_by_lines_or_wrapped(spark):
    header = "Copyright 2020 X\n" + SENTENCES["apache_header"] + "\n" + SENTENCES["apache_use"]
    wrapped = re.sub(r"(.{40}\S*) ", r"\1\n", MIT)
    line = "A title\nReleased under the MIT License.\n"
    cut = header.replace("except in", "except\nin")  # the header by lines, its second sentence wrapped
    bsd = re.sub(r"(.{40}\S*) ", r"\1\n", BSD2)
    assert scanned(spark, [header + "\n\n" + wrapped, wrapped + "\n\n" + header, line + "\n" + bsd, cut]) == [
        (5, "Apache-2.0,MIT", 0), (5, "Apache-2.0,MIT", 0), (4, "BSD-2-Clause,MIT", 0), (2, "Apache-2.0", 0),
    ]


def test_every_rule_names_its_licence(spark):
    """A text of a rule's sentences in order gives that licence alone, by lines and wrapped."""
    by_lines = ["\n\n".join(SENTENCES[k] for k in rule) for _, rule in RULES]
    wrapped = [re.sub(r"(\S+ \S+ \S+ \S+) ", r"\1\n", t) for t in by_lines]
    want = [(len(rule), name, 0) for name, rule in RULES]
    assert scanned(spark, by_lines) == want
    assert scanned(spark, wrapped) == want


def test_the_other_sql_tells_licences_apart(spark, tmp_path):
    """The registered SQL, written from literal lines, agrees on a table of lines of all its kinds."""
    import duckdb

    from sparkpact.llm.licenses import OP8_SQL, license_scan

    lines = ["Released under the MIT License.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 2."]
    texts = [f"Some words. {a}\n{b}" for a in lines for b in lines] + [f"{a}\n{a}\nx" for a in lines] + [f"It is not {a}" for a in lines] + ["", None, "license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.register("documents", documents)
    want = {r[0]: r[1:] for r in con.execute(OP8_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_known"], r["licenses"], r["n_unmatched"]) for r in license_scan(df).collect()}
    assert got == want
