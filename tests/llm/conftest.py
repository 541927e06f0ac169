import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, size long, kept string, _fp int"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties, repeats, shared passages and clashing columns."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        body = " ".join(word() for _ in range(rng.randrange(0, 120)))
        if i % 5 == 0:
            body += "\n" + passage + "  " + word()
        rows.append((i, body, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None])))
    rows += [(100 + i, rows[5][1], "en", "s1") for i in range(8)]  # copies
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n", "en", "s2"), (203, "!!! 123", "de", "s2"), (None, "no id", "en", "s1"), (None, None, None, None)]
    rows += [rows[7], rows[7], rows[200 % 60]]  # the same rows again
    rows += [(300, " ".join(word() for _ in range(6000)), "en", "s10"), (301, "x" * 50000, "en", None), (302, "Straße É 日本語 \U0001f600 fin", "de", "s1")]
    rows.append((303, rows[-3][1] + " tail", "en", "s10"))  # near copy
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(*r, 0, "clash", 1, "clash", 2) for r in corpus], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
