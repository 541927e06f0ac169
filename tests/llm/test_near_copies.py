import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sparkpact.llm import components as components_
from sparkpact.llm import near_copies
from sparkpact.llm.near_copies import similar_groups
from sparkpact.llm.shared import materialize


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {b" ".join(w)} - {b""}


def components(texts):
    """Of each text, the first that similar pairs reach: all pairs that share a shingle are compared."""
    sets, having = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            having.setdefault(x, []).append(i)
    first = list(range(len(texts)))

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in {p for rows in having.values() for p in combinations(rows, 2)}:
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            first[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_stage_of_the_pipeline_on_planted_copies(spark, sf_dir):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    group = components([t for _, t in rows])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert got == [i for n, (i, _) in enumerate(rows) if group[n] == n]
    # near copies with other fingerprints: 1 and 177, 6 and 145
    assert {1, 6} <= set(got) and not {145, 177} & set(got)


def test_chains_and_groups(spark, largest=4, levels=1):
    """With buckets so small, leaders, dealing anew and the comparison of what is left all take part."""
    rng = random.Random(largest)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    texts = ["", None, "a", "A", "a b c d", "a b c d e"]
    for _ in range(3):
        chain = [word() for _ in range(100)]
        for _ in range(12):  # each a step from a text before it, far from the first
            chain = list(chain)
            chain[rng.randrange(100)] = word()
            texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join([word() for _ in range(40)]) for _ in range(20)] + [passage + " " + " ".join([word() for _ in range(40)]) for _ in range(20)]
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near-test")
    rows = similar_groups(df, largest=largest, levels=levels).collect()
    assert {r["_id"]: r["component_id"] for r in rows} == dict(enumerate(components(texts)))


@pytest.mark.parametrize("few", [64, 5, 1])
def test_pairs_by_brute_force(few):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    sim = base[rng.integers(0, 6, 400)]
    for _ in range(60):
        sim[np.arange(400), rng.integers(0, 4, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    bucket, n, comp = np.sort(rng.integers(0, 4, 400)), rng.integers(36, 46, 400), rng.integers(0, 30, 400)
    comp[rng.random(400) < 0.5] = 77
    far = np.bitwise_count(sim[:, None] ^ sim[None]).sum(axis=2)
    least = np.minimum(n[:, None], n)
    fits = (bucket[:, None] == bucket) & (comp[:, None] != comp) & (far <= np.where(least < 40, 80, 64)) & (5 * least >= 4 * np.maximum(n[:, None], n))
    want = {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(fits)), strict=True) if a < b}
    assert len(want) > 500
    # in turns: the rows that are done have no pairs left, and at the end all have been named
    left, seen = np.arange(400), set()
    for turn in range(8):
        i, j, done = near_copies.near_pairs(bucket[left], sim[left], n[left], comp[left], turn, few)
        named = {(min(a, b), max(a, b)) for a, b in zip(left[i].tolist(), left[j].tolist(), strict=True)}
        assert named <= want
        seen |= named
        over = set(left[done].tolist())
        assert all(p in seen for p in want if over & set(p))
        left = left[~np.isin(left, left[done])]
    assert seen == want


def test_hubs_are_leaders():
    """Variants of one text that are near each other but similar to it alone: it leads, and each is judged once."""
    rng = np.random.default_rng(2)
    hub = rng.integers(0, 2**63, 4, dtype=np.uint64)
    sim = np.repeat(hub[None], 500, axis=0)
    for r in range(1, 500):
        bits = rng.choice(256, 26, replace=False)
        np.bitwise_xor.at(sim[r], bits // 64, np.uint64(1) << (bits % 64).astype(np.uint64))
    order = rng.permutation(500)
    i, j, done = near_copies.near_pairs(np.zeros(500, np.int64), sim[order], np.full(500, 100), np.arange(500), 0)
    assert order[done].tolist() == [0] and len(i) == 499 and set(i.tolist()) == set(done.tolist())


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [b" ".join(rng.choices([b"ab", b"C", b"longword" * 6], k=k)) for k in (0, 3, 80, 200)]
    want = [x.tolist() for x in near_copies.shingle_sets(texts)]
    monkeypatch.setattr(near_copies, "PIECE_BYTES", 200)
    monkeypatch.setattr("sparkpact.llm.simhash.PIECE_BYTES", 200)
    assert [x.tolist() for x in near_copies.shingle_sets(texts)] == want


def test_empty(no_docs):
    assert similar_groups(no_docs).collect() == []


def variants(n, words_, changed, seed):
    """Texts that each differ from one text, which is not among them, in some words of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    base, texts = [word() for _ in range(words_)], []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words_), changed):
            own[k] = word()
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("hashes", [near_copies.SETS, 0])
def test_near_group_without_a_hub(spark, monkeypatch, hashes):
    """Texts within the radius that are not similar: their pairs are judged in the bucket, where its sets fit, and not as rows."""
    texts = [t for k in range(6) for t in variants(40, 120, 3, k)]
    monkeypatch.setattr(near_copies, "SETS", hashes)
    judged, labelled = [], []
    judge, label = near_copies.Similar.judge, near_copies.Similar.labelled
    monkeypatch.setattr(near_copies.Similar, "judge", lambda self, pairs: judged.append(pairs.distinct().count()) or judge(self, pairs))
    monkeypatch.setattr(near_copies.Similar, "labelled", lambda self, rows, labels: labelled.append(out := label(self, rows, labels)) or out)
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near-test")
    got = {r["_id"]: r["component_id"] for r in similar_groups(df).collect()}
    want = dict(enumerate(components(texts)))
    assert got == want and len(set(want.values())) > 20
    # later turns make no pairs of rows, and the labels of all that is left are joined once
    assert (sum(judged[1:]) == 0) == (hashes > 0)
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in labelled)


def test_links_of_a_bucket_by_brute_force():
    texts = [t.encode() for k, c in enumerate((0, 1, 2, 3, 4)) for t in variants(25, 60, c, k)] + [b"a", b"a b c d e f"]
    h, n = near_copies.shingle_sets(texts)
    comp = np.arange(len(n)) // 2 * 2
    i, j = near_copies.set_links(h, near_copies.wide_prints(h, n), n, comp)
    want, label = components([t.decode() for t in texts]), np.arange(len(n))
    # what stood in one component before is joined as well
    for a, b in [*zip(i, j, strict=True), *zip(comp, np.arange(len(n)), strict=True), *enumerate(want)]:
        label[label == label[a]] = label[b]
    mine = np.arange(len(n))
    for a, b in [*zip(i, j, strict=True), *zip(comp, np.arange(len(n)), strict=True)]:
        mine[mine == mine[a]] = mine[b]
    assert [len({*mine[label == x]}) for x in np.unique(label)] == [1] * len(np.unique(label))
    assert all(want[a] == want[b] for a, b in zip(i, j, strict=True))


def test_pairs_meet_each_set_once(spark, tmp_path):
    """A hub on both sides of more pairs than a task should get: the plan joins each pair once with either side's sets."""
    texts = variants(1, 60, 0, 1) + variants(700, 60, 2, 1)
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near-test")
    own = near_copies.keyed(df, _id=near_copies.column("doc_id"), _text=near_copies.column("text").cast("binary")).select("_rk_file", "_rk_row", "_id", "_text")
    near_copies.workers(spark)
    prints = own.mapInArrow(near_copies._print_batches, "_rk_file long, _rk_row long, _id long, _fp long, _n long, s0 long, s1 long, s2 long, s3 long, _bands array<long>")
    prints = materialize(prints, "near-test")
    similar = near_copies.Similar(prints, own.select("_rk_file", "_rk_row", "_text"))
    nodes = sorted(r["_fp"] for r in prints.select("_fp").collect())
    hub = nodes[350]
    pairs = spark.createDataFrame([(min(hub, x), max(hub, x)) for x in nodes if x != hub], "a long, b long")
    joins = []
    write = near_copies.materialize
    near_copies.materialize = lambda x, name, *more: joins.append(x._jdf.queryExecution().analyzed().toString()) or write(x, name, *more) if name == "near-links" else write(x, name, *more)
    try:
        similar.judge(pairs)
    finally:
        near_copies.materialize = write
    hashes = {f: set(h.tolist()) for f, h in ((int(near_copies.set_hashes(*near_copies.shingle_sets([t.encode()])).view(np.int64)[0]), near_copies.shingle_sets([t.encode()])[0]) for t in texts)}
    want = {tuple(p) for p in pairs.collect() if 9 * len(hashes[p[0]] & hashes[p[1]]) >= 4 * (len(hashes[p[0]]) + len(hashes[p[1]]))}
    assert {tuple(r) for r in similar.links.collect()} == want
    # the pairs are parted by the hot keys of b before any set is joined
    assert len(joins) == 1 and "LeftSemi" in joins[0]


def test_links_are_contracted_before_the_stars(spark, monkeypatch):
    """A chain of near copies, which the stars alone halve in turns of four tables each: after contraction a turn finds them done."""
    words_ = [f"w{i}" for i in range(400)]
    texts = [" ".join(words_[8 * k : 8 * k + 120]) for k in range(32)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    write = components_.materialize
    monkeypatch.setattr(components_, "materialize", lambda x, name: made.append(name) or write(x, name))
    got = {r["_id"]: r["component_id"] for r in similar_groups(df).collect()}
    assert got == dict(enumerate(components(texts))) and set(got.values()) == {0}
    # the links of the turn and those of all turns
    assert made.count("cc-edges") <= 4


@pytest.mark.parametrize("together", [1 << 20, 7])
def test_contracted_links_by_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(near_copies, "LINKS", together)
    rng = random.Random(5)
    edges = [(rng.randrange(-60, 60) * 3, rng.randrange(-60, 60) * 3) for _ in range(70)]
    batches = [near_copies.pa.RecordBatch.from_arrays([near_copies.pa.array(x) for x in zip(*edges[lo : lo + 5], strict=True)], ["a", "b"]) for lo in range(0, 70, 5)]
    found = [(r["a"], r["b"]) for batch in near_copies._forest_batches(iter(batches)) for r in batch.to_pylist()]

    def labels(links):
        label = {x: x for e in edges for x in e}
        for a, b in links:
            label = {x: min(label[a], label[b]) if y in (label[a], label[b]) else y for x, y in label.items()}
        return label

    assert labels(found) == labels(edges)
    if together > len(edges):
        assert sorted((y, x) for x, y in labels(edges).items() if x != y) == sorted(found)
