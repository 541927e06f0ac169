import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sparkpact.llm.entries import ORACLE_SQL, QUERIES
from sparkpact.llm.language_id import LEAST, Scorer, fit, predict
from sparkpact.llm.mixing import mix, mixed_documents
from sparkpact.llm.shared import _folder, materialize

from ..oracle import agree
from .test_near_copies import components


def test_op1_against_sql(spark, sf_dir):
    agree(QUERIES["op1_exact_dedup"](spark, sf_dir), ORACLE_SQL["op1_exact_dedup"], sf_dir)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


def documents(sf_dir):
    return sorted(duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet'").fetchall())


def identified(spark, sf_dir, texts):
    """Those texts in which some language has more than half, by the network's own scores."""
    scorer = Scorer(fit(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return {t for t in texts if t and any(c.isalpha() for c in t) and predict([t.encode()], scorer)[0].max() >= LEAST}


def test_stages_against_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t, *_ in documents(sf_dir)]
    good = identified(spark, sf_dir, {t for _, t in rows})
    kept: dict = {}
    for i, t in rows:
        if t in good:
            kept[t] = max(i, kept.get(t, i))
    left = sorted((i, t) for t, i in kept.items())
    group = components([t for _, t in left])
    left = [x for n, x in enumerate(left) if group[n] == n]

    out = corpus_pipeline.run(spark, sf_dir).collect()
    # the mix alone is taken from the operator, which has its own test
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).filter(f"doc_id in ({','.join(str(i) for i, _ in left)})")
    copies = {r["doc_id"]: r["_copies"] for r in mix(docs).collect()}
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in left:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want += [(i, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * copies[i]
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out) == sorted(want)
    assert len(corpus_pipeline.STAGES) == 5
    # of its own tables only the last one is left
    left_over = [d for d in os.listdir(_folder(spark).removeprefix("file:")) if d.startswith("pipeline-")]
    assert len(left_over) == 1


CLASHES = ["_metadata", "_rk_row", "_rk_file", "_bm_slot", "_bm_word", "_text", "_size", "_copy", "_copies", "_source", "_h", "_lang", "_score", "c0", "c1", "node", "TEXT2"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Rows of the documents' columns and of every name that stages use inside, with values that must stay."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(12)]
    texts += [texts[0], texts[1] + " tail", "", None]
    rows = [(i, t, "en", "s1", 1, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)
    path = str(tmp_path_factory.mktemp("clash") / "t")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_stages_keep_columns_of_any_name(spark, clashing, stage):
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert 5 <= len(rows) and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)


def test_exploded_and_joined_input(spark, clashing):
    """Rows that come from one place of a file are several, for every stage that tells rows apart."""
    twice = clashing.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    distinct = {r["text"] or "" for r in clashing.collect()}
    kept = corpus_pipeline.exact_dedup(spark, twice, "").collect()
    assert Counter(r["text"] or "" for r in kept) == dict.fromkeys(distinct, 1)
    near = corpus_pipeline.near_dedup(spark, clashing.unionByName(clashing), "")
    assert len({r["doc_id"] for r in near.collect()}) == near.count() == len(set(components(sorted(distinct))))
    both = clashing.join(spark.range(2).withColumnRenamed("id", "other"), F.lit(True))
    assert mixed_documents(both).count() > 0
    assert corpus_pipeline.language_id(spark, twice, "").count() == 2 * (clashing.count() - 2)


def test_two_thousand_rows_of_one_id(spark):
    """Rows without an id, and rows that repeat wholly, are taken one by one: targets are met."""
    rng = random.Random(5)
    rows = [(None, " ".join(["w"] * rng.randrange(1, 6)), f"s{i % 3}") for i in range(2000)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "one-id")
    by: dict = {}
    for r in mix(df).collect():
        by.setdefault((r["source"], r["_target"]), []).append(r["_copies"] * r["_size"])
    assert all(abs(sum(taken) - target) <= 5 for (_, target), taken in by.items()) and len(by) == 3


def test_unwanted_languages_go(spark, sf_dir):
    from sparkpact.llm.language_id import keep_identified

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = keep_identified(docs, languages=("de",)).collect()
    assert kept and sum(r["lang"] == "de" for r in kept) >= 0.95 * len(kept) and len(kept) >= 0.9 * docs.filter("lang = 'de'").count()
    assert keep_identified(docs, least=1.01).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert keep_identified(unlabelled).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
