import random
import zlib

import numpy as np
import pytest

from sparkpact.llm.language_id import WINDOW, Scorer, fit, held_out, identify, keep_identified, predict, train

WORDS = {"en": "the of and to in that with for this which".split(), "de": "der und die nicht mit sich auf eine wird über".split(), "fr": "le de que les dans pour une est être très".split()}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, text(lang, rng.randrange(3, 200), rng), lang if i % 10 else None, "s", "clash", 1.0, lang))
    rows += [(900, None, "en", "s", "", 0.0, ""), (901, "", "en", "s", "", 0.0, ""), (902, "12 34 !?", "de", "s", "", 0.0, ""), (None, text("fr", 50, rng), "fr", "s", "", 0.0, "fr"), (5, rows[5][1], "en", "s", "", 0.0, rows[5][6])]
    rows.append((903, text("de", 20000, rng), None, "s", "", 0.0, "de"))
    path = str(tmp_path_factory.mktemp("lang") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string, score double, truth string").write.parquet(path)
    return spark.read.parquet(path)


def test_accuracy_and_rules(spark, table):
    net = fit(table, sample=150)
    rows = identify(table.withColumn("held", held_out("doc_id")), net).collect()
    assert len(rows) == table.count()
    for r in rows:
        assert r["held"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    told = [r["lang_pred"] == r["truth"] for r in rows if r["truth"] and r["held"]]
    assert len(told) > 50 and sum(told) / len(told) > 0.97


def test_prediction_by_brute_force():
    """Table lookups give what embedding, convolution, maximum and softmax give, over all windows of a text."""
    rng = random.Random(1)
    langs = ["en", "de", "fr"] * 20
    net = train([text(x, 30, rng).encode() for x in langs], langs)
    texts = [text("de", 400, rng).encode(), b"x", "é".encode() * 500]
    got = predict(texts, Scorer(net), rows_at_once=3)
    for t, p in zip(texts, got, strict=True):
        each = []
        t = t.ljust(-(-len(t) // WINDOW) * WINDOW)
        for at in range(0, len(t), WINDOW):
            w = t[at : at + WINDOW]
            h = np.concatenate([np.max([sum(f[i][w[j + i]] for i in range(len(f))) for j in range(WINDOW - len(f) + 1)], axis=0) for f in net.tables])
            z = np.maximum(h + net.bias, 0) @ net.dense + net.out
            each.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        assert np.allclose(p, np.mean(each, axis=0), atol=1e-4)


def test_labels_do_not_leak(spark, table):
    """Labels of rows held out, and unlabelled rows, change nothing."""
    from pyspark.sql import functions as F

    other = table.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    a, b = fit(table, sample=50), fit(other, sample=50)
    assert a.labels == b.labels and np.array_equal(a.dense, b.dense)


def test_no_labels(spark, table):
    none = table.filter("false")
    assert fit(none) is None and identify(none, None).collect() == []
    assert {r["lang_pred"] for r in identify(table.limit(5), None).collect()} == {"und"}


def test_stage(table):
    kept = keep_identified(table, least=0.0)
    assert kept.columns == table.columns
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() == table.count() - 3
    assert keep_identified(table).count() > 0.97 * kept.count()


def test_many_languages_share_the_sample(spark):
    """No language is left out: with 300 of them, and copies of a text that crowd one, each is learnt."""
    rows = [(4 * i + j, f"{chr(97 + i // 20)}{chr(97 + i % 20)}x{j} " * 5, f"l{i:03d}") for i in range(300) for j in range(4)]
    rows += [(10000 + i, "copied text of one language", "l000") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(fit(df, sample=3, total=600).labels) >= 295


def test_held_out_accuracy(spark):
    """The registered query on documents: the quarter that the network has not seen."""
    from sparkpact.llm.entries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    out = QUERIES["op5_language_id"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.filter("held_out").collect()
    assert len(rows) > 200 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
