"""SimHash near-dedup by bit-sliced comparison.

Fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks of their bits, so only
distinct fingerprints that share a block meet, in a bucket. A bucket of more than
BUCKET of them is dealt anew by the blocks of the bits that are left. After the last level
9 bits are left, and so 512 fingerprints at most: nothing is capped. Inside a run of buckets the fingerprints lie as 64 vertical
bit planes. Shifting the planes by d compares every fingerprint with the d-th after it;
carry-save counters of two bits and an overflow bit add up the distances of 64 pairs an
operation, and words all of whose pairs are over the radius are abandoned. A bucket
emits links to its components' first members, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import without_rows
from .shared import KEY, Flat, column, join_counted, keyed, materialize, tables, workers
from .textops import BLOCK_BYTES, Words, blocks, byte_sizes, words, xxh64

RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints that a bucket may hold before its remaining bits deal it anew.
BUCKET = 512
#: Bits of a block at each level: 4 blocks of the 64, of the 48 left, of the 36 left and so on.
LEVELS = (16, 12, 9, 6, 5, 4, 3)
#: Rows that are compared together.
CHUNK = 1 << 15
#: Bytes of one text that are hashed at a time.
PIECE_BYTES = 1 << 20

# byte -> its 8 bits, one in each byte of a word
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number for each text; short texts are one shingle, empty ones none."""
    count = np.diff(w.first)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    last = at + np.repeat(np.minimum(count, n) - 1, number)
    return w.start[at], w.end[last], number


def bit_counts(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many of each text's number[i] hashes have each of 64 bits set."""
    out = np.zeros((len(number), 64), np.int64)
    has = np.flatnonzero(number)
    if not len(h):
        return out
    first = np.concatenate([[0], np.cumsum(number[has])[:-1]])
    # a byte counts up to 255, so texts are summed in runs of 255 at most
    runs = (number[has] + 254) // 255
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    text = np.cumsum(runs) - runs
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[bytes_[:, k]], at).view(np.uint8).reshape(-1, 8)
        out[has, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.int64), text, axis=0)
    return out


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(w: Words, n: int) -> np.ndarray:
    start, end, _ = _shingles(w, n)
    return xxh64(w.buf, start, end)


def piece_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """The hashes of a long text's shingles, in parts: each part has the words of PIECE_BYTES bytes or so and,
    before them, those that its first shingles begin with. A text of fewer than n words is one shingle.
    """
    lo, before, short = 0, b"", True
    while lo < len(text):
        m = _SPACES.search(text, lo + PIECE_BYTES)
        hi = m.start() if m else len(text)
        w = words([before + b" " + text[lo:hi]])
        if len(w.start) >= n:
            short = False
            yield _hashes(w, n)
        # words that no shingle has begun with yet
        at = max(0, len(w.start) - n + 1)
        before = w.buf[w.start[at] : w.end[-1]].tobytes() if at < len(w.start) else b""
        lo = hi
    if short and before:
        yield _hashes(words([before]), n)


def majority(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The SimHash of each text's number[i] hashes; that of none is 0."""
    return _voted(bit_counts(h, number), number)


def _voted(counts: np.ndarray, number: np.ndarray) -> np.ndarray:
    set_ = (2 * counts > number[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel() if len(number) else np.zeros(0, np.uint64)


def fingerprints(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text; that of a text without words is 0."""
    w = words([t.lower() if len(t) <= PIECE_BYTES else b"" for t in texts])
    start, end, number = _shingles(w, n)
    counts = bit_counts(xxh64(w.buf, start, end), number)
    for i in (i for i, t in enumerate(texts) if len(t) > PIECE_BYTES):
        for h in piece_hashes(texts[i].lower(), n):
            counts[i] += bit_counts(h, np.array([len(h)]))[0]
            number[i] += len(h)
    return _voted(counts, number)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("_text")
        fps = [np.zeros(0, np.uint64)]
        for lo, hi in blocks(byte_sizes(text), BLOCK_BYTES):
            part = text.slice(lo, hi - lo).to_pylist()
            fps.append(fingerprints([b"" if t is None else t for t in part], n))
        fp = pa.array(np.concatenate(fps).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], [*batch.schema.names[:-1], "_fp"])


def near_rows(bucket: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of one bucket that differ in `radius` bits at most, by distance in the table; rows are sorted by bucket.

    fp: a word or several for each row.
    """
    fp = fp if fp.ndim == 2 else fp[:, None]
    size = 1
    rows = np.arange(len(fp))
    for d in range(1, len(fp)):
        if d >= size:  # twice as far, with the rows only of buckets that reach as far
            edge = np.flatnonzero(np.concatenate([[True], bucket[rows][1:] != bucket[rows][:-1]]))
            length = np.diff(np.concatenate([edge, [len(rows)]]))
            rows = rows[np.repeat(length > d, length)]
            if not len(rows):
                break
            own, size = bucket[rows], 2 * d
            planes = _planes(fp[rows])
        same = np.zeros(len(rows), bool)
        same[:-d] = own[:-d] == own[d:]
        if not same.any():
            continue
        i = _near(planes, _packed(same), d, radius)
        if len(i):
            yield rows[i], rows[i + d]


def linked(bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For each row, the first row that a chain of links joins it to; rows are sorted by bucket."""
    label = np.arange(len(fp))
    for i, j in near_rows(bucket, fp, RADIUS):
        _union(label, i, j)
    return label


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as words, and a spare word."""
    out = np.zeros((len(bits) + 63) // 64 * 8 + 8, np.uint8)
    got = np.packbits(bits, bitorder="little")
    out[: len(got)] = got
    return out.view(np.uint64)


def _planes(fp: np.ndarray) -> list[np.ndarray]:
    """Bit plane k holds bit k of every fingerprint; a second spare word ends it."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    return [np.concatenate([_packed(np.ascontiguousarray(bits[:, k])), [np.uint64(0)]]) for k in range(bits.shape[1])]


def _near(planes: list[np.ndarray], active: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Those active rows i that differ from row i + d in `radius` bits at most.

    counters[k] holds bit k of 64 distances a word; they start so that the count after `radius` overflows.
    """
    word, low = d // 64, np.uint64(d % 64)
    high = np.uint64(64) - low
    at = np.flatnonzero(active)
    over = ~active[at]
    top = len(planes[0]) - 1
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    every = np.uint64(2**64 - 1)
    counters = [np.full(len(at), every if start >> k & 1 else np.uint64(0)) for k in range(width)]
    for k, plane in enumerate(planes):
        other = plane[np.minimum(at + word, top)]
        if low:
            other = (other >> low) | (plane[np.minimum(at + word + 1, top)] << high)
        carry = plane[at] ^ other
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if k % 8 == 7:
            alive = np.flatnonzero(~over)
            if len(alive) < len(at):
                at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
            if not len(at):
                return at
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    where, bit = np.nonzero(bits)
    return at[where] * 64 + bit


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; every label names its set's first row afterwards."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label[:] = next_


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links(bucket, fp):
        label = linked(bucket, fp)
        i = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[label[i]].view(np.int64))], ["a", "b"])

    bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        bucket = np.concatenate([bucket, batch.column("bucket").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        while len(fp) >= CHUNK:
            cut = int(np.searchsorted(bucket, bucket[min(len(fp), 2 * CHUNK) - 1]))  # the last bucket may go on
            if not cut:
                break
            yield links(bucket[:cut], fp[:cut])
            bucket, fp = bucket[cut:], fp[cut:]
    if len(fp):
        yield links(bucket, fp)


def _deal(rows: DataFrame, bits: int) -> DataFrame:
    """Each row once for each of 4 blocks of its rest: bucket is hashed with the block, rest loses it."""
    each = [
        F.struct(
            F.expr(f"xxhash64(bucket, {t}, shiftrightunsigned(rest, {bits * t}) & {(1 << bits) - 1}L)").alias("bucket"),
            F.expr(
                (f"shiftleft(shiftrightunsigned(rest, {bits * (t + 1)}), {bits * t}) | " if bits * (t + 1) < 64 else "")
                + f"(rest & {(1 << (bits * t)) - 1}L)"
            ).alias("rest"),
        )
        for t in range(4)
    ]
    return rows.select(F.explode(F.array(*each)).alias("d"), "fp").select("d.bucket", "d.rest", "fp")


def fingerprint_links(fps: DataFrame, largest: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) whose components are those of all near pairs."""
    rows = fps.select(F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"), "fp")
    dealt = None
    for bits in LEVELS:
        rows = materialize(_deal(rows, bits), "sim-buckets")
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(counts.filter(F.col("n") > largest), "sim-large")
        done = large.isEmpty() or bits == LEVELS[-1]
        ready = (rows if done else rows.join(large, "bucket", "left_anti")).select("bucket", "fp")
        dealt = ready if dealt is None else dealt.unionByName(ready)
        if done:
            break
        rows = join_counted(rows, large, "bucket", "n").select("bucket", "rest", "fp")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_link_batches, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The row key, _id, _fp, component_id and kept of each row.

    A null text counts as empty; texts without words have the fingerprint 0, which links like
    any other. Long texts are hashed piece by piece and wholly. component_id is the smallest id that
    links reach; nulls are passed over, unless all are null. Exactly one row of a component is kept: the
    first by id (nulls last) and place. An empty table gives an empty result. Other columns of docs play
    no part, whatever their names.
    """
    workers(docs.sparkSession)
    own = keyed(docs, _id=column(id_col), _text=column(text_col).cast("binary")).select(*KEY, "_id", "_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1])
    prints = materialize(own.mapInArrow(lambda b: _fingerprint_batches(b, shingle), f"{fields}, _fp long"), "sim-prints")
    return members(prints, fingerprint_links)


def members(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prints with component_id and kept; links gives links (a, b) between their distinct fingerprints (fp)."""
    first = F.min(F.struct(F.col("_id").isNull(), "_id", *KEY)).alias("rep")
    with tables(prints.sparkSession):
        fps = materialize(prints.groupBy(F.col("_fp").alias("fp")).agg(first, F.count(F.lit(1)).alias("n")), "sim-distinct")
        labels = materialize(connected_components(links(fps.select("fp")), "a", "b"), "sim-labels")
        by_label = labels.join(fps, labels["node"] == fps["fp"]).groupBy("label").agg(F.min("rep").alias("_whole"), F.count(F.lit(1)).alias("m"))
        by_label = materialize(by_label, "sim-components")
        whole = materialize(join_counted(labels, by_label, "label", "m").select("node", "_whole"), "sim-members")
        reps = fps.join(whole, fps["fp"] == whole["node"], "left").select(F.col("fp").alias("_fp"), "n", F.coalesce("_whole", "rep").alias("rep"))
        reps = materialize(reps, "sim-reps", outlives=True)
    return join_counted(prints, reps, "_fp", "n").select(
        *KEY,
        "_id",
        "_fp",
        F.col("rep._id").alias("component_id"),
        F.struct(*[F.col(f"rep.{k}") for k in KEY]).eqNullSafe(F.struct(*KEY)).alias("kept"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and the smallest doc_id that links of 3 bits reach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; all columns stay as they are, whatever their names."""
    flat = Flat(docs)
    with tables(docs.sparkSession):
        gone = simhash_groups(flat.rows, flat.name("doc_id"), flat.name("text")).filter("not kept")
        gone = materialize(gone.select(*KEY), "gone", outlives=True)
    return without_rows(flat, gone)
