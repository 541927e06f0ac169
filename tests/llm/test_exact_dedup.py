from collections import defaultdict

from pyspark.sql import functions as F

from sparkpact.llm.exact_dedup import dedup_state, drop_copies, exact_dedup
from sparkpact.llm.shared import KEY, new_path


def brute(corpus):
    groups = defaultdict(list)
    for i, text, *_ in corpus:
        groups[text or ""].append(i)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=repr), len(groups)


def test_groups(docs, corpus):
    rows = exact_dedup(docs).collect()
    want, groups = brute(corpus)
    assert sorted(((r["_id"], r["keep_id"], r["group_size"]) for r in rows), key=repr) == want
    assert sum(r["kept"] for r in rows) == groups
    assert all(r["_id"] == r["keep_id"] for r in rows if r["kept"])


def test_colliding_digests(docs, corpus):
    """With a digest of a few bits, texts of one digest differ; the full texts decide."""
    rows = exact_dedup(docs, digest=lambda t: F.unhex(F.hex(F.pmod(F.length(t), F.lit(7)).cast("string").cast("binary")))).collect()
    want, groups = brute(corpus)
    assert sorted(((r["_id"], r["keep_id"], r["group_size"]) for r in rows), key=repr) == want
    assert sum(r["kept"] for r in rows) == groups


def test_small_batches_and_later_runs(spark, tmp_path):
    """State outlives micro-batches and the query itself."""
    path, checkpoint = str(tmp_path / "in"), new_path(spark, "state")
    row = "named_struct('f', 0L, 'r', id)"
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(cast(id % 5 as string) as binary) as _digest", "id as _id", f"{row} as _locator")
    make(0, 20).repartition(4).write.parquet(path)
    read = lambda: spark.readStream.schema(make(0, 1).schema).option("maxFilesPerTrigger", "1").parquet(path)
    assert {(r["_keep"]["_id"], r["_size"]) for r in dedup_state(read(), checkpoint).collect()} == {(i, 4) for i in range(15, 20)}
    make(20, 25).write.mode("append").parquet(path)
    assert {(r["_keep"]["_id"], r["_size"]) for r in dedup_state(read(), checkpoint).collect()} == {(i, 5) for i in range(20, 25)}


def test_empty(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_stage(docs, corpus):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.select("text").collect()) == sorted({t or "" for _, t, *_ in corpus})
    assert not set(KEY) & set(kept.columns)
