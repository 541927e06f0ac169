import hashlib
import random

import pyarrow as pa
import pytest

from sparkpact.llm import pieces
from sparkpact.llm.token_counts import count_tokens, safe_parts, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "foo", "'s", "123", "<|endoftext|>", "</s>", "<s>", "\x00", "\xa0", " ", "日本", "🙂", "́", "ﬁ", "﻿", "​", ".", "_", "\x85", "\x1c", "Ⅷ", "<0x41>"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    return ["", " ", "  ", "a", " a", "a ", "\n", "x" * 3000, "ab " * 2000, None] + ["".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(1500)]


def test_counts_are_the_library_s(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert count_tokens(pa.array(texts), BPE).tolist() == want


def test_parts_make_up_the_text(texts):
    assert all("".join(safe_parts(t)) == t for t in texts if t)


def test_token_counts(docs, no_docs, corpus):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    want = sorted(((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in corpus), key=repr)
    assert sorted((tuple(r) for r in token_counts(docs, BPE).collect()), key=repr) == want
    assert any(w[3] for w in want)
    assert token_counts(no_docs, BPE).collect() == []


def test_ids_and_texts_are_the_library_s(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    ids, decoded = pieces.encode_decode(pa.array(texts), PIECES)
    assert [x.tolist() for x in ids] == want
    assert decoded == [sp.decode(x) for x in want]


def test_encode_pieces(docs, no_docs, corpus):
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, *_ in corpus:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r) for r in pieces.encode_pieces(docs, PIECES, digests=True).collect()), key=repr) == sorted(want, key=repr)
    full = pieces.encode_pieces(docs, PIECES).filter("_id = 302").first()
    assert full["decoded"].endswith("fin") and len(full["ids"]) == 4 * full["n_tokens"]
    assert pieces.encode_pieces(no_docs, PIECES).collect() == []
