"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a white-space marker after another character, and its
normalizer only turns blanks into markers and puts one in front. So a text falls into
chunks, a run of markers and what follows up to the next, that no piece crosses. Each
distinct chunk of a batch is segmented, and decoded, once; ids and decoded texts are
joined by position. Models for which this does not hold are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, workers
from .textops import blocks, byte_sizes

#: Bytes of text that share a table of chunks.
BATCH_BYTES = 1 << 20
#: Chunks that a worker remembers between batches, and how long they may be.
REMEMBERED, LONGEST_REMEMBERED = 1 << 16, 48
MARKER = "▁"
_CHUNK = re.compile(" *[^ ]+| +")


class Model:
    """A SentencePiece model, and the chunks that it has segmented."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check()
        # a marker with nothing after it; encode("") would give no ids at all
        alone = np.array([self.sp.piece_to_id(MARKER)], "<u4").tobytes()
        self.known: dict[str, tuple[bytes, str]] = {"": (alone, "")}

    def check(self) -> None:
        sp = self.sp
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        probe = "a  b\tc ﬁ  "
        if sp.piece_to_id(MARKER) == sp.unk_id():
            raise ValueError("this model has no piece for a single marker")
        if sp.decode(sp.encode(probe)) != probe or sp.encode_as_pieces("a")[0][0] != MARKER:
            raise ValueError("this model's normalizer does more than mark blanks")

    def segmented(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Of each chunk (without its first marker): its ids, and what they decode to."""
        out: list = [self.known.get(c) for c in chunks]
        new = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = self.sp.encode([chunks[i] for i in some], num_threads=1)
            texts = self.sp.decode(ids, num_threads=1)
            for i, own, text in zip(some, ids, texts, strict=True):
                out[i] = (np.array(own, "<u4").tobytes(), text)
                if len(chunks[i]) <= LONGEST_REMEMBERED and len(self.known) < REMEMBERED:
                    self.known[chunks[i]] = out[i]
        return out


_model = functools.lru_cache(maxsize=4)(Model)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    if not text:
        return []
    return [c[1:] for c in _CHUNK.findall(" " + text.replace(MARKER, " "))]


def _coded(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, the code of each chunk, how many chunks each text has)."""
    # words between single blanks are their own chunks
    plain = pc.invert(pc.match_substring_regex(text, f"^$|^ |  | $|{MARKER}"))
    is_plain = plain.to_numpy(zero_copy_only=False)
    split = pc.split_pattern(text.filter(plain), " ")
    rest = [chunks_of(t) for t in text.filter(pc.invert(plain)).to_pylist()]
    size = np.zeros(len(text), np.int64)
    size[is_plain] = np.diff(split.offsets.to_numpy())
    size[~is_plain] = [len(c) for c in rest]
    words = pa.concat_arrays([split.flatten(), pa.array([c for own in rest for c in own], pa.string())])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    # the chunks of plain texts come first there; back to the order of the texts
    order = np.argsort(np.repeat(~is_plain, size), kind="stable")
    by_text = np.empty(len(code), np.int64)
    by_text[order] = code
    return coded.dictionary.to_pylist(), by_text, size


def _ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start[i]:start[i] + size[i]] of all i, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def encode_decode(text: pa.Array, path: str) -> tuple[list[np.ndarray], list[str]]:
    """Of each text: its ids, with those that begin and end it, and the text that they decode to."""
    model = _model(path)
    text = pc.fill_null(text, "")
    listed, code, size = _coded(text)
    done = model.segmented(listed)
    begin, finish = np.uint32(model.sp.bos_id()), np.uint32(model.sp.eos_id())
    ids = np.frombuffer(b"".join(b for b, _ in done), "<u4")
    count = np.array([len(b) // 4 for b, _ in done], np.int64)
    start = np.cumsum(count) - count
    changed = np.array([d != c for c, (_, d) in zip(listed, done, strict=True)], bool)
    all_ids = _ragged(ids, start[code], count[code]) if len(code) else np.zeros(0, np.uint32)
    end = np.cumsum(size)
    ends = np.concatenate([[0], np.cumsum(count[code])])
    odd = np.concatenate([[0], np.cumsum(changed[code])])
    out_ids, out_text = [], []
    for i, t in enumerate(text.to_pylist()):
        lo, hi = end[i] - size[i], end[i]
        out_ids.append(np.concatenate([[begin], all_ids[ends[lo] : ends[hi]], [finish]]))
        if odd[hi] == odd[lo] and MARKER not in t:
            out_text.append(t)
        else:
            out_text.append(" ".join([done[k][1] for k in code[lo:hi]]))
    return out_ids, out_text


def _batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            for lo, hi in blocks(byte_sizes(text), BATCH_BYTES):
                ids, decoded = encode_decode(text.slice(lo, hi - lo), path)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:-1],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array(decoded, pa.string()),
                    ],
                    [*rows.schema.names[:-1], "n_tokens", "ids", "decoded"],
                )

    return run


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(path)(batches):
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in column.cast(pa.binary()).to_pylist()], pa.string()) for column in b.columns[-2:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *digests], [*b.schema.names[:-2], "ids_sha256", "decoded_sha256"])

    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """The id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of each row, or digests of the last two.

    Ids include those that begin and end a text. A null text counts as empty: these two
    ids, and the empty text. Rows that repeat are encoded each; an empty table gives an
    empty result. Other columns of docs play no part, whatever their names. path: a model's file, on all executors.
    """
    workers(docs.sparkSession)
    own = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    if digests:
        return own.mapInArrow(_digest_batches(path), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return own.mapInArrow(_batches(path), f"_id {kind}, n_tokens long, ids binary, decoded string")


def piece_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(docs, path, digests=True).withColumnRenamed("_id", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
