from collections import Counter

import numpy as np
import pytest

from sparkpact.llm import substring_dedup as module
from sparkpact.llm.entries import QUERIES
from sparkpact.llm.substring_dedup import Subtree, cut, numbered_words, pieces, substring_dedup
from sparkpact.llm.textops import words


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def results(df, **options):
    return sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df, **options).collect())


@pytest.mark.parametrize("hot", [1 << 15, 20, 2, 0])
def test_corpus(docs, corpus, hot):
    want = brute([t for _, t, *_ in corpus], 35)
    assert sum(r[1] for r in want) > 500
    assert results(docs, hot_from=hot) == want


@pytest.mark.parametrize(("window", "prefixes", "hot"), [(5, (2,), 1 << 15), (5, (5,), 1 << 15), (7, (3, 5), 3), (7, (2, 4, 6), 1)])
def test_repetitive_texts(spark, window, prefixes, hot):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60))) for _ in range(40)] + ["a " * 200, "a b " * 50, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert results(df, window=window, prefixes=prefixes, hot_from=hot) == brute(texts, window)


def test_most_frequent_windows(spark, monkeypatch):
    """Windows above the bound of the broadcast are found without a shuffle, others beside them with one."""
    texts = ["a b c d e f g"] * 300 + ["x y a b c d z"] * 3 + [f"p{i} q r s t u" for i in range(50)] + ["q r s t u"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert results(df, window=4, prefixes=(2, 3), hot_from=1) == brute(texts, 4)


def test_subtree():
    # suffixes of four words: 0 and 2 are alike, 1 shares two words with them, 3 stands below another root
    sym = np.array([7, 8, 1, 2, 7, 8, 3, 3, 7, 8, 1, 2, 7, 8, 1, 2])
    tree = Subtree(sym, np.array([0, 4, 8, 12]), np.array([0, 0, 0, 1]), 4)
    assert tree.node[0] == tree.node[2] >= 0 and tree.node[1] == tree.node[3] == -1
    assert tree.below[tree.node[0]] == 4
    # edges of one word show all nodes: 7, 78, 781, 7812
    wide = Subtree(sym * 2**40, np.array([0, 4, 8, 12]), np.array([0, 0, 0, 1]), 4)
    assert wide.below.tolist() == [1, 2, 3, 4] and wide.parent.tolist() == [-1, 0, 1, 2]


def test_words_decide_where_hashes_agree(monkeypatch):
    texts = [b"aa bb aa cc", b"bb longword-one longword-two aa"]
    number = numbered_words(words(texts))
    listed = b" ".join(texts).split()
    assert [number[i] == number[j] for i in range(8) for j in range(8)] == [a == b for a in listed for b in listed]
    monkeypatch.setattr(module, "xxh64", lambda buf, start, end: np.zeros(len(start), np.uint64))
    number = numbered_words(words(texts))
    assert [number[i] == number[j] for i in range(8) for j in range(8)] == [a == b for a in listed for b in listed]


def test_pieces(monkeypatch):
    monkeypatch.setattr(module, "PIECE_BYTES", 50)
    rng = np.random.default_rng(4)
    text = b" ".join(rng.choice([b"a", b"bcd", b"x" * 80], 400)) + b"  \n"
    whole = text.split()
    for share in (0, 4):
        at = 0
        for w, before in pieces(text, share):
            own = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            assert before == max(at - share, 0) and own == whole[before : before + len(own)] and len(own) > share
            at = before + len(own)
        assert at == len(whole)
    lo, hi = np.array([0, 30, 390]), np.array([3, 200, 400])
    assert cut(text, lo, hi) == (400, 183, b" ".join(whole[3:30] + whole[200:390]))


def test_long_texts(spark, tmp_path):
    """Texts of several MB, of one word, of many words, and of a passage that stands across the pieces of one."""
    rng = np.random.default_rng(5)
    many = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 400_000).tolist())
    passage = " ".join(many.split()[300_000:300_200])
    texts = ["x" * 5_000_000, many, "y " + passage, "x" * 5_000_000 + " a b c d", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert results(df) == brute(texts, 35)


def test_registered_query(spark, sf_dir):
    import hashlib

    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    out = QUERIES["op4_substring_dedup"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = sorted((n, gone, hashlib.sha256(kept.encode()).hexdigest()) for n, gone, kept in brute([t for _, t in rows], 35))
    got = out.collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]


def test_empty(no_docs):
    assert results(no_docs) == []
