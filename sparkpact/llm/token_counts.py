"""Token counts: batch encoding in Arrow functions that return lengths alone.

A worker takes its rows in batches of about BATCH_BYTES bytes, however many rows that
is, and cuts every text at boundaries that no token crosses: before a single blank
between two characters that are no white space. There byte-level pre-tokenizers
always begin a new word, and no special token holds a blank. So the tokens of a text are
those of its parts, and a batch encodes each distinct part once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, workers
from .textops import blocks, byte_sizes

#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20
#: Counts of parts that a worker remembers between batches.
REMEMBERED = 1 << 18
#: Longer parts are encoded but not remembered.
LONGEST_REMEMBERED = 64

#: Characters that some engine takes for white space, in a form that RE2 and Python read.
_WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_BOUNDARY = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
#: A text that this doesn't match has a boundary at every blank.
_UNSAFE = f"^ | $| [{_WHITE}]|[{_WHITE}] "


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    _check(json.loads(own.to_str()))
    own.no_truncation()
    own.no_padding()
    return own, {}


def _check(tokenizer: dict) -> None:
    """Refuses tokenizers whose tokens may cross a safe boundary, or that count otherwise than by parts."""
    before = tokenizer["pre_tokenizer"] or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the pre-tokenizer must be byte-level, split words and add no blank in front")
    if tokenizer["normalizer"] is not None or tokenizer["model"]["type"] != "BPE" or tokenizer["model"].get("dropout"):
        raise ValueError("there must be no normalizer, and a BPE model without dropout")
    for token in tokenizer["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(f"[{_WHITE}]", token["content"]):
            raise ValueError(f"the added token {token['content']!r} may take blanks along")


def safe_parts(text: str) -> list[str]:
    """The text, cut before each blank that has no white space beside it."""
    cut = [0, *(m.start() for m in _BOUNDARY.finditer(text)), len(text)]
    return [text[i:j] for i, j in zip(cut, cut[1:], strict=False)]


def _part_counts(parts: list[str], path: str) -> np.ndarray:
    tokenizer, known = _tokenizer(path)
    out = np.empty(len(parts), np.int64)
    new: list[int] = []
    for i, part in enumerate(parts):
        n = known.get(part)
        if n is None:
            new.append(i)
        else:
            out[i] = n
    for lo in range(0, len(new), 4096):
        some = new[lo : lo + 4096]
        for i, e in zip(some, tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False), strict=True):
            out[i] = n = len(e)
            if len(parts[i]) <= LONGEST_REMEMBERED and len(known) < REMEMBERED:
                known[parts[i]] = n
    return out


def count_tokens(text: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text; nulls count as empty."""
    text = pc.fill_null(text, "")
    out = np.zeros(len(text), np.int64)
    plain = pc.invert(pc.match_substring_regex(text, _UNSAFE))
    first = pc.split_pattern(text.filter(plain), " ")
    words, size = first.flatten(), np.diff(first.offsets.to_numpy())
    # a word after the first takes its blank along
    head = np.zeros(len(words), bool)
    head[(np.cumsum(size) - size)[size > 0]] = True
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    listed = coded.dictionary.to_pylist()
    used = np.unique(code[~head])
    inner = np.zeros(len(listed), np.int64)
    inner[used] = _part_counts([" " + listed[i] for i in used], path)
    heads = np.unique(code[head])
    outer = np.zeros(len(listed), np.int64)
    outer[heads] = _part_counts([listed[i] for i in heads], path)
    each = np.where(head, outer[code], inner[code])
    total = np.concatenate([[0], np.cumsum(each)])
    end = np.cumsum(size)
    is_plain = plain.to_numpy(zero_copy_only=False)
    out[is_plain] = total[end] - total[end - size]
    rest = np.flatnonzero(~is_plain)
    if len(rest):
        cut = [safe_parts(t) for t in text.filter(pc.invert(plain)).to_pylist()]
        listed = list(dict.fromkeys(p for parts in cut for p in parts))
        n = dict(zip(listed, _part_counts(listed, path).tolist(), strict=True))
        out[rest] = [sum(n[p] for p in parts) for parts in cut]
    return out


def _count_batches(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            size = byte_sizes(text)
            found = [np.zeros(0, np.int64)]
            found += [count_tokens(text.slice(lo, hi - lo), path) for lo, hi in blocks(size, BATCH_BYTES)]
            n = np.concatenate(found)
            arrays = [*batch.columns[:-1], pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """The id, n_bytes, n_tokens and over_limit of each row. path: a tokenizer's file, on all executors.

    A null text counts as empty: no bytes, no tokens. Rows that repeat are counted
    each; an empty table gives an empty result. Other columns of docs
    play no part, whatever their names.
    """
    workers(docs.sparkSession)
    own = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(_count_batches(path, limit), f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("_id", "doc_id")
