import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkpact.llm.entries import QUERIES
from sparkpact.llm.mtree import Index, Tree, dots, lifted, top_k, whole_vectors


def brute(rows, queries, k=5):
    """rows: (id, whole vector); each row is told from others by its place in the list."""
    out = []
    for q in queries:
        qid, v = rows[q]
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(rows) if j != q and len(w) == len(v))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "clusters", "equal"])
def test_tree_finds_the_nearest(shape):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 60, (700, 8)))
    if shape == "clusters":
        x = np.repeat(np.floor(rng.normal(0, 300, (7, 8))), 100, axis=0) + np.floor(rng.normal(0, 3, (700, 8)))
    if shape == "equal":
        x[100:] = x[0]
    most = (x * x).sum(axis=1).max()
    tree = Tree(lifted(x, most), page=16)
    asked = np.arange(0, 700, 50)
    who, rows, computed, visited = tree.search(x[asked], 5, np.full(14, np.inf), asked)
    for i, q in enumerate(asked.tolist()):
        score = dots(x, x[q][None])[:, 0]
        best = np.sort(np.delete(score, q))[::-1][:5]
        assert np.sort(score[rows[who == i]])[::-1][:5].tolist() == best.tolist()
    if shape == "clusters":
        # the bounds rule rows and pages out
        assert computed < 14 * 700 * 0.6 and visited < 14 * len(tree.pages) * 0.5


def test_exact_scores():
    big = np.array([[2.0**40, 3.0], [1.0, -(2.0**62)]])
    assert dots(big, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3], [2**20 - 2**62]]


def table(spark, vectors, path):
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, id string, v string").write.parquet(path)
    return spark.read.parquet(path)


def whole(vectors):
    return [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    vectors += [(400 + i, vectors[3][1]) for i in range(190)]  # ties, more than a shard holds
    vectors += [(50, vectors[9][1]), (500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (550, [0.5, 0.5]), (551, [0.25, -1.0]), (600, [])]
    df = table(spark, [(*v, 0, "c", "c") for v in vectors], str(tmp_path / "e"))
    rows = whole_vectors(df)
    good = whole(vectors)
    assert rows.count() == len(good)
    got = sorted(tuple(r) for r in top_k(rows, rows.filter("id % 50 = 0"), shard_rows=lambda dim: F.lit(64)).collect())
    assert got == brute(good, [j for j, (i, _) in enumerate(good) if i % 50 == 0])


def test_registered_query(spark, sf_dir):
    import pyarrow.parquet as pq

    own = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    good = whole(list(zip(own["vec_id"], own["embedding"], strict=True)))
    out = QUERIES["op3_mtree_search"](spark, sf_dir)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    x = np.array([v for _, v in good], np.int64)
    want = []
    for j, (i, _) in enumerate(good):
        if i % 50 == 0:
            score = x @ x[j]
            best = sorted((-s, k) for (k, _), s, n in zip(good, score.tolist(), range(len(good)), strict=True) if n != j)[:5]
            want += [(i, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_clustered_vectors_leave_most_pages_unread(spark, tmp_path):
    """100,000 rows in clusters: fewer than half of the shards are reached, fewer than half of the pages visited."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (100, 16))
    x = np.floor(centres[np.arange(100_000) % 100] + rng.normal(0, 4, (100_000, 16)))
    pq = pytest.importorskip("pyarrow.parquet")
    import pyarrow as pa

    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 16, pa.int32()), pa.array(x.ravel()))
    path = str(tmp_path / "e.parquet")
    pq.write_table(pa.table({"id": np.arange(len(x)), "place": [str(i) for i in range(len(x))], "v": flat}), path, row_group_size=20_000)
    rows = spark.read.parquet(path)
    index = Index(rows, lambda dim: F.lit(2048))
    queries = rows.filter("id % 500 = 0")
    got = sorted(map(tuple, index.top_k(queries, 5).collect()))
    want = []
    for q in range(0, 100_000, 500):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        want += [(q, n + 1, int(i), int(score[i])) for n, i in enumerate(best.tolist())]
    assert got == sorted(want)
    shards = index.shards.count()
    assert shards > 40 and index.reached.count() < 200 * shards / 2


def test_clashing_names_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = [(0, [1.0], 1, 1, 1, 1, 1), (None, [2.0], 2, 2, 2, 2, 2), (2, [2.0], 3, 3, 3, 3, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, _metadata int, _rk_row int, place int, v int, node int").write.parquet(path)
    rows = whole_vectors(spark.read.parquet(path))
    assert [tuple(r) for r in top_k(rows, rows.filter("id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 256 * 512), (0, 2, None, 256 * 512)]


def test_few_and_none(spark, tmp_path):
    df = table(spark, [(0, [1.0], 0, "", ""), (1, [2.0], 0, "", "")], str(tmp_path / "e"))
    rows = whole_vectors(df)
    assert [tuple(r) for r in top_k(rows, rows.filter("id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    none = whole_vectors(df.filter("false"))
    assert top_k(none, none).collect() == []
