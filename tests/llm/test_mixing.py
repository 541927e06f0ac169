import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkpact.llm.mixing import document_rates, mix, mixed_documents, source_targets


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, ratio=1.5, most=2):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), ratio * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(docs, corpus):
    rows = mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for _, text, _, source in corpus:
        sizes[source] += size_of(text)
    want = water(sizes)
    taken = defaultdict(int)
    longest = defaultdict(int)
    for r in rows:
        assert r["_size"] == size_of(r["text"]) and r["_source_size"] == sizes[r["source"]]
        assert r["_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["_copies"] <= 2
        taken[r["source"]] += r["_copies"] * r["_size"]
        longest[r["source"]] = max(longest[r["source"]], r["_size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, longest[s] / 2, 3)


def test_reruns_agree(docs):
    runs = [sorted(mix(docs).selectExpr("doc_id", "_copies").collect(), key=repr) for _ in range(2)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 100, "b": 1, None: 1}, {"a": 1, "b": 1000, "c": 1000, "d": 50, "é": 70, "z": 0}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df, (5.0, 2.0, 1.0), 1.5, 2).collect()}
    assert got == pytest.approx(water(sizes)) if any(sizes.values()) else set(got.values()) == {0.0}


def test_many_alike(spark):
    """One source of equal sizes: the threshold by hash gives the exact count."""
    df = spark.range(3000).selectExpr("id as doc_id", "'a b' as text", "concat('s', id % 3) as source")
    df = df.unionByName(spark.range(5000, 5004).selectExpr("id as doc_id", "'q' as text", "'s0' as source"))
    rows = mix(df).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["_copies"] * r["_size"]
    want = {r["source"]: r["_target"] for r in rows}
    assert all(abs(by[s] - want[s]) <= 2 for s in want)


def test_empty(no_docs):
    assert mix(no_docs).collect() == []


def test_stage(docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    key = lambda r: repr((r["doc_id"], r["text"], r["source"]))
    want = Counter()
    for r in mix(docs).collect():
        want[key(r)] += r["_copies"]
    assert Counter(key(r) for r in out.collect()) == +want


def test_rates_have_the_greatest_entropy(spark):
    """The cells' rates are those of the convex dual's optimum, found here by bisection of its one equation a source."""
    rng = np.random.default_rng(3)
    cells = [(f"s{k}", int(x), float(x), int(n)) for k in range(3) for x, n in zip(np.unique(rng.integers(1, 400, 30)), rng.integers(1, 50, 30), strict=False)]
    size: dict = {}
    for s, _, x, n in cells:
        size[s] = size.get(s, 0) + int(x * n)
    share = {"s0": 0.4, "s1": 1.3, "s2": 1.9}
    df = spark.createDataFrame(cells, "source string, cell long, size double, n long")
    targets = spark.createDataFrame([(s, size[s], share[s] * size[s]) for s in size], "source string, source_size long, target double")
    got = {(r["source"], r["size"]): r["rate"] for r in document_rates(df, targets, 2.0).collect()}
    for s in size:
        x, n = (np.array([c[i] for c in cells if c[0] == s], float) for i in (2, 3))
        lo, hi = -1.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (n * x * 2 / (1 + np.exp(-mid * x))).sum() < share[s] * size[s] else (lo, mid)
        assert [got[s, v] for v in x.tolist()] == pytest.approx((2 / (1 + np.exp(-lo * x))).tolist(), abs=2e-3)


def test_registered_query(spark, sf_dir):
    from sparkpact.llm.entries import QUERIES

    out = QUERIES["op2_mixing"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, rows = defaultdict(int), defaultdict(int), out.collect()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == size_of(d["text"]) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
    want = water(sizes)
    assert {docs[r["doc_id"]]["source"]: r["target"] for r in rows} == pytest.approx(want)
    assert all(abs(taken[s] - t) <= max(0.02 * t, 50) for s, t in want.items())
