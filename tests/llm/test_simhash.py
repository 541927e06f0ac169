import random

import numpy as np
import pytest
import xxhash

from sparkpact.llm import simhash
from sparkpact.llm.components import connected_components
from sparkpact.llm.simhash import drop_near_copies, fingerprint_links, fingerprints, linked, simhash_groups


def fingerprint(text):
    words = text.lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Of each fingerprint, the first that links reach."""
    first = list(range(len(fps)))

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("piece", [4 << 20, 200])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
    rng = random.Random(3)
    texts = [b"", b" ", b"A", b"a b", b"a b c", "É é ß".encode()] + [b" ".join(rng.choices([b"ab", b"C", "É".encode(), b"longword" * 6], k=rng.randrange(500))) for _ in range(60)]
    assert fingerprints(texts).tolist() == [fingerprint(t) for t in texts]


def near(rng, bases, each, bits):
    fp = np.repeat(rng.integers(0, 2**63, bases, dtype=np.uint64), each)
    for _ in range(bits):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    return np.unique(fp)


def test_comparison_in_buckets():
    rng = np.random.default_rng(1)
    for _ in range(10):
        fp = near(rng, 40, 12, 3)
        fp = fp[rng.permutation(len(fp))]
        bucket = np.sort(rng.integers(0, 9, len(fp))).astype(np.int64)
        want = np.arange(len(fp))
        for b in range(9):
            i = np.flatnonzero(bucket == b)
            want[i] = i[components([int(x) for x in fp[i]])]
        assert linked(bucket, fp).tolist() == want.tolist()


@pytest.mark.parametrize("largest", [512, 4])
def test_links_over_levels(spark, largest):
    fp = near(np.random.default_rng(2), 15, 20, 4)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r["node"]: r["label"] for r in connected_components(fingerprint_links(df, largest), "a", "b").collect()}
    want = components([int(x) for x in fp])
    groups: dict = {}
    for i, x in enumerate(fp.view(np.int64).tolist()):
        groups.setdefault(want[i], []).append(x)
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (159, 300), (-5, 300)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: -5 for i in [*range(100, 160), 300, -5]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_groups(docs, no_docs, corpus):
    rows = simhash_groups(docs).collect()
    fps = [fingerprint((t or "").encode()) for _, t, *_ in corpus]
    group = components(fps)
    least: dict = {}
    for (i, *_), g in zip(corpus, group, strict=True):
        if i is not None and (least.get(g) is None or i < least[g]):
            least[g] = i
        least.setdefault(g, None)
    want = sorted(((i, f, least[g]) for (i, *_), f, g in zip(corpus, fps, group, strict=True)), key=repr)
    assert sorted(((r["_id"], r["_fp"] % 2**64, r["component_id"]) for r in rows), key=repr) == want
    assert sum(r["kept"] for r in rows) == len(set(group))
    assert least[group[-1]] == 300  # the near copy is linked to its original
    assert simhash_groups(no_docs).collect() == []


def test_stage(docs, corpus):
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 300 in ids and 303 not in ids and len(ids) == len(set(components([fingerprint((t or "").encode()) for _, t, *_ in corpus])))
