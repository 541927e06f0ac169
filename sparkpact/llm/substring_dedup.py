"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat of WINDOW words or more is a node of the corpus's suffix tree at least that
deep. Its suffixes are dealt out by prefixes of variable length, until a group fits in memory:

* Of a window's grams of PREFIXES[0] words the least by hash (the leftmost of equals) is its
  anchor, the same in all copies of the window, so only anchors need be counted. An anchor
  that occurs once has one leaf below it and no repeat.
* For anchors that occur up to HOT times, the suffixes that begin with the windows of that anchor
  go to one task, as the text of the words that the windows cover. There the subtree grows top
  down: a node's leaves are parted by the words of the next edge, and nodes with one leaf are
  dropped. What is left at WINDOW words are the deep internal nodes: their leaves are repeats.
  Words are compared as such.
* Windows of more frequent anchors take the least of their longer grams, of PREFIXES[1] words and so
  on. Where the longest is still too frequent, the prefix is all of the window: such a node is
  its own subtree, and its leaves are counted, combined before the shuffle, by 128 bits of hash.

Overlapping repeats are merged to maximal stretches of words. Which way an anchor takes follows from
bitmaps of bounded size; an anchor that a bitmap admits by chance finds itself alone in its
subtree. Texts longer than PIECE_BYTES are read in pieces that share WINDOW - 1 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from .shared import KEY, bitmap, column, in_bitmap, join_counted, keyed, materialize, split_by_keys, tables, workers
from .shared import HOT as HOT_KEYS
from .textops import Words, blocks, byte_sizes, mixed, words, xxh64

WINDOW, PREFIXES = 35, (8, 16, 24)
#: Occurrences of a prefix that one task's subtree may hold: about 10 MB of text.
HOT = 1 << 15
#: Suffixes whose subtrees grow together.
CHUNK = 1 << 17
#: Bytes of one text that are handled at a time.
PIECE_BYTES = 1 << 20
#: Bits of a bitmap for each key that it holds, and at most (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse, modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, 1 << 17)
        base = int(_BASES[which])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[which] = tuple(both)
    up, down = _powers[which]
    return up, down


def gram_hash(sym: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of sym[i:i + k] for every i."""
    n = len(sym)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(which, n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sym * up[:n], dtype=np.uint64)])
        return mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def _leftmost_min(g: np.ndarray, span: int) -> np.ndarray:
    """Of each g[i:i + span], the place of the least, the first of equals."""
    at, value, reach = np.arange(len(g)), g, 1

    def both(step):
        left, right = value[:-step], value[step:]
        take = right < left
        return np.where(take, at[step:], at[:-step]), np.where(take, right, left)

    while reach * 2 <= span:
        at, value = both(reach)
        reach *= 2
    if reach < span:
        at, value = both(span - reach)
    return at


class Part(NamedTuple):
    """Some texts of a batch, or a piece of one: their words, their rows, and how many words of the text stand before."""

    w: Words
    row: np.ndarray
    before: np.ndarray


def pieces(text: bytes, share: int) -> Iterator[tuple[Words, int]]:
    """The words of a long text in pieces, and how many words stand before each; a piece begins with `share` words
    of the last one, and a piece has more words than that.
    """
    lo, head, before = 0, b"", 0
    while lo < len(text):
        m = _SPACES.search(text, lo + PIECE_BYTES)
        hi = m.start() if m else len(text)
        w = words([head + b" " + text[lo:hi]])
        n = len(w.start)
        if n > share:
            yield w, before
        at = max(0, n - share)
        before += at
        head = w.buf[w.start[at] : w.end[-1]].tobytes() if at < n else b""
        lo = hi


def parts(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[tuple[pa.RecordBatch, Part]]:
    for batch in batches:
        text = batch.column("_text")
        size = byte_sizes(text)
        for lo, hi in blocks(size):
            own = [b"" if t is None else t for t in text.slice(lo, hi - lo).to_pylist()]
            if len(own) == 1 and size[lo] > PIECE_BYTES:
                for w, before in pieces(own[0], share):
                    yield batch, Part(w, np.array([lo]), np.array([before]))
            else:
                yield batch, Part(words(own), np.arange(lo, hi), np.zeros(hi - lo, np.int64))


class Windows:
    """The windows of a part and their hashed words."""

    def __init__(self, part: Part, window: int):
        self.part, self.window = part, window
        w = part.w
        self.sym = xxh64(w.buf, w.start, w.end)
        count = np.diff(w.first)
        starts = np.maximum(count - window + 1, 0)
        before = np.cumsum(starts) - starts
        #: their first words
        self.starts = np.repeat(w.first[:-1] - before, starts) + np.arange(starts.sum())
        self.text = np.repeat(np.arange(len(count)), starts)

    def anchors(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window, and its hash."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gram = gram_hash(self.sym, prefix)
        at = _leftmost_min(gram, self.window - prefix + 1)[self.starts]
        return at, gram[at]

    def narrowed(self, hot: list, prefixes: tuple[int, ...]) -> Windows:
        """Only those windows whose anchors of each of the lengths may be hot."""
        for words_, prefix in zip(hot, prefixes, strict=False):
            pick = in_bitmap(words_, self.anchors(prefix)[1])
            self.starts, self.text = self.starts[pick], self.text[pick]
        return self

    def place(self, batch: pa.RecordBatch, which: np.ndarray) -> list[pa.Array]:
        """Row key, and number of the first word, of the windows `which`."""
        text, start = self.text[which], self.starts[which]
        rows = pa.array(self.part.row[text])
        return [*(batch.column(k).take(rows) for k in KEY), pa.array(start - self.part.w.first[text] + self.part.before[text])]


def _windows(batches, window: int, hot, prefixes: tuple[int, ...]) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    maps = [h.value for h in hot]
    for batch, part in parts(batches, window - 1):
        own = Windows(part, window).narrowed(maps, prefixes)
        if len(own.starts):
            yield batch, own


def _hot_batches(window: int, hot, prefixes: tuple[int, ...]):
    """Rows with a window of a frequent anchor."""

    def some(batches):
        for batch in batches:
            rows = [own.part.row[np.unique(own.text)] for _, own in _windows([batch], window, hot, prefixes)]
            if rows:
                yield batch.take(pa.array(np.unique(np.concatenate(rows))))

    return some


def _runs(at: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins, and the end."""
    return np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))


def _count_batches(window: int, prefix: int, hot, above: tuple[int, ...]):
    """How often each anchor occurs."""

    def count(batches):
        for _, own in _windows(batches, window, hot, above):
            at, key = own.anchors(prefix)
            key, n = np.unique(key[_runs(at)[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return count


_CONTEXT = f"key long, {KEY[0]} long, {KEY[1]} long, lo long, around binary"


def _context_batches(window: int, prefix: int, hot, above: tuple[int, ...], some, too_hot):
    """A row for each run of windows with one anchor that may repeat: its first word's place, and the words that the windows cover."""

    def contexts(batches):
        for batch, own in _windows(batches, window, hot, above):
            at, key = own.anchors(prefix)
            edge = _runs(at)
            # windows side by side: narrowing may have left gaps
            gap = np.flatnonzero(np.diff(own.starts) != 1) + 1
            edge = np.union1d(edge, gap)
            first, last = edge[:-1], edge[1:] - 1
            pick = in_bitmap(some.value, key[first]) & ~in_bitmap(too_hot.value, key[first])
            first, last = first[pick], last[pick]
            if not len(first):
                continue
            w = own.part.w
            begin, end = w.start[own.starts[first]], w.end[own.starts[last] + window - 1]
            size = end - begin
            off = np.concatenate([[0], np.cumsum(size)])
            data = w.buf[np.repeat(begin - off[:-1], size) + np.arange(off[-1])]
            blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *own.place(batch, first), blob], ["key", *KEY, "lo", "around"])

    return contexts


def numbered_words(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words alone: hashes are confirmed on the words."""
    h = xxh64(w.buf, w.start, w.end)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    like = first[number]
    size = w.end - w.start
    same = size == size[like]
    wide = np.ndarray((len(w.buf) - 7,), "<u8", w.buf, strides=(1,))
    at = np.flatnonzero(same)
    for k in range(0, int(size.max(initial=0)), 8):
        at = at[size[at] > k]
        rest = np.minimum(size[at] - k, 8).astype(np.uint64)
        mask = np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest)
        same[at] = ((wide[w.start[at] + k] ^ wide[w.start[like[at]] + k]) & mask) == 0
        at = at[same[at]]
    if not same.all():  # two words of one hash
        listed = [w.buf[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(x, len(seen)) for x in listed], np.int64)
    return number


class Subtree:
    """The suffix tree of some suffixes, cut at `depth` words, without its nodes of one leaf.

    sym: numbered words, each suffix being sym[at[i]:at[i] + depth]; group: the root below which it stands.
    node[i] is the deep node that suffix i is a leaf of, or -1; parent and below give each node's
    parent (-1 for children of roots) and depth.
    """

    def __init__(self, sym: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int):
        bits = max(1, int(sym.max(initial=0)).bit_length())
        step = min(depth, 64 // bits)
        packed = sym.astype(np.uint64)
        for k in range(1, step):
            packed = (packed << np.uint64(bits)) | np.concatenate([sym[k:].astype(np.uint64), np.zeros(min(k, len(sym)), np.uint64)])[: len(sym)]
        self.node = np.full(len(at), -1, np.int64)
        rows, node = np.arange(len(at)), group
        parents, depths = [], []
        base = 0
        root = True
        for lo in range(0, depth, step):
            # the last edge goes on from where it has only words before `depth`
            edge = packed[at[rows] + min(lo, depth - step)]
            order = np.lexsort((edge, node))
            rows, node, edge = rows[order], node[order], edge[order]
            begin = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])]))
            leaves = np.diff(np.concatenate([begin, [len(rows)]]))
            inner = leaves > 1
            number = np.cumsum(inner) - 1 + base
            parents.append(np.full(inner.sum(), -1) if root else node[begin[inner]])
            depths.append(np.full(inner.sum(), min(lo + step, depth)))
            base += int(inner.sum())
            keep = np.repeat(inner, leaves)
            rows, node, root = rows[keep], np.repeat(number, leaves)[keep], False
            if not len(rows):
                break
        else:
            self.node[rows] = node
        self.parent, self.below = np.concatenate(parents), np.concatenate(depths)


def _tree_batches(window: int):
    names = ("key", *KEY, "lo")

    def spans(rows: dict[str, np.ndarray], around: list[bytes]):
        w = words(around)
        n = np.diff(w.first) - window + 1
        context = np.repeat(np.arange(len(n)), n)
        x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.concatenate([[0], np.cumsum(rows["key"][1:] != rows["key"][:-1])])
        tree = Subtree(numbered_words(w), w.first[context] + x, group[context], window)
        deep = np.flatnonzero(tree.node >= 0)
        # the windows of a context overlap, so those that repeat have no gap between them
        hit, first = np.unique(context[deep], return_index=True)
        last = np.concatenate([first[1:], [len(deep)]])[: len(first)] - 1
        lo = rows["lo"][hit]
        return pa.RecordBatch.from_arrays([*(pa.array(rows[k][hit]) for k in KEY), pa.array(lo + x[deep[first]]), pa.array(lo + x[deep[last]] + window)], [*KEY, "lo", "hi"])

    def trees(batches):
        rows = {k: np.zeros(0, np.int64) for k in names}
        around: list[bytes] = []
        load = np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column("around").to_pylist()
            rows = {k: np.concatenate([rows[k], batch.column(k).to_numpy().astype(np.int64)]) for k in names}
            around += own
            load = np.concatenate([load, [t.count(b" ") + 2 - window for t in own]])
            # whole groups of CHUNK suffixes or so at a time
            while True:
                cut = int(np.searchsorted(np.cumsum(load), CHUNK))
                if cut >= len(load):
                    break
                cut = int(np.searchsorted(rows["key"], rows["key"][cut]))
                if not cut:
                    cut = int(np.searchsorted(rows["key"], rows["key"][0], "right"))
                    if cut == len(around):
                        break
                yield spans({k: v[:cut] for k, v in rows.items()}, around[:cut])
                rows, around, load = {k: v[cut:] for k, v in rows.items()}, around[cut:], load[cut:]
        if around:
            yield spans(rows, around)

    return trees


def _whole_counts(window: int, hot, above: tuple[int, ...]):
    """How often each window occurs, by two hashes."""

    def count(batches):
        for _, own in _windows(batches, window, hot, above):
            h = np.stack([gram_hash(own.sym, window, k)[own.starts].view(np.int64) for k in (0, 1)], axis=1)
            h, n = np.unique(h, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(n)], ["h0", "h1", "n"])

    return count


def _whole_batches(window: int, hot, above: tuple[int, ...], some, frequent):
    """Places of windows that repeat: those of the most frequent ones, without hashes, and those that may repeat, with them."""

    def windows(batches):
        most = frequent.value
        alike = int(np.diff(_runs(most[:, 0])).max()) if len(most) else 0  # how many share a first hash
        for batch, own in _windows(batches, window, hot, above):
            h0, h1 = (gram_hash(own.sym, window, k)[own.starts].view(np.int64) for k in (0, 1))
            at = np.searchsorted(most[:, 0], h0)
            sure = np.zeros(len(h0), bool)
            for k in range(alike):
                here = np.minimum(at + k, len(most) - 1)
                sure |= (most[here, 0] == h0) & (most[here, 1] == h1)
            # of the most frequent, those that overlap or touch as one stretch
            hit = np.flatnonzero(sure)
            first = np.flatnonzero(np.concatenate([[True], (own.text[hit][1:] != own.text[hit][:-1]) | (np.diff(own.starts[hit]) > window)])) if len(hit) else hit
            last = np.concatenate([first[1:], [len(hit)]])[: len(first)] - 1
            rest = np.flatnonzero(~sure & in_bitmap(some.value, h0.view(np.uint64)))
            *row, lo = own.place(batch, np.concatenate([hit[first], rest]))
            size = np.concatenate([own.starts[hit[last]] - own.starts[hit[first]], np.zeros(len(rest), np.int64)]) + window
            none = np.arange(len(size)) < len(first)
            hashes = [pa.array(np.concatenate([np.zeros(len(first), np.int64), h[rest]]), mask=none) for h in (h0, h1)]
            yield pa.RecordBatch.from_arrays([*hashes, *row, lo, pa.array(lo.to_numpy() + size)], ["h0", "h1", *KEY, "lo", "hi"])

    return windows


def _sized_bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap with BITS_A_KEY bits a key or so, MOST_BITS at most."""
    n = keys.count()
    return bitmap(keys, key, min(MOST_BITS, 1 << max(16, (BITS_A_KEY * n).bit_length())))


def repeat_spans(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, hot_from: int = HOT) -> DataFrame:
    """(row key, lo, hi): the stretches of words that windows occurring twice or more cover, merged. docs: the row key and _text (binary)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(*KEY, "_text")
    found: list[DataFrame] = []
    hot: list = []
    for level, prefix in enumerate(prefixes):
        above = prefixes[:level]
        counts = texts.mapInArrow(_count_batches(window, prefix, list(hot), above), "key long, n long")
        counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "sub-prefixes")
        some = sc.broadcast(_sized_bitmap(counts, "key"))
        large = counts.filter(F.col("n") > hot_from)
        too_hot = sc.broadcast(_sized_bitmap(large, "key"))
        contexts = texts.mapInArrow(_context_batches(window, prefix, list(hot), above, some, too_hot), _CONTEXT)
        dealt = contexts.repartition("key").sortWithinPartitions("key")
        found.append(dealt.mapInArrow(_tree_batches(window), f"{KEY[0]} long, {KEY[1]} long, lo long, hi long"))
        if large.isEmpty():
            break
        hot.append(too_hot)
        if not level:
            # only these texts are read from now on
            texts = materialize(texts.mapInArrow(_hot_batches(window, list(hot), prefixes), texts.schema), "sub-hot")
    else:
        counts = texts.mapInArrow(_whole_counts(window, list(hot), prefixes), "h0 long, h1 long, n long")
        twice = materialize(counts.groupBy("h0", "h1").agg(F.sum("n").alias("n")).filter("n > 1"), "sub-twice")
        total = twice.agg(F.sum("n")).first()[0] or 0
        # fewer than HOT_KEYS windows are that frequent: they need no shuffle
        is_most = F.col("n") > max(total // HOT_KEYS, 256)
        rows = twice.filter(is_most).select("h0", "h1").orderBy("h0", "h1").toArrow()
        most = sc.broadcast(np.stack([rows.column(k).to_numpy() for k in ("h0", "h1")], axis=1))
        some = sc.broadcast(_sized_bitmap(twice.filter(~is_most), "h0"))
        places = texts.mapInArrow(_whole_batches(window, list(hot), prefixes, some, most), f"h0 long, h1 long, {KEY[0]} long, {KEY[1]} long, lo long, hi long")
        places = materialize(places, "sub-windows")
        rest = places.filter("h0 is not null").join(twice.filter(~is_most), ["h0", "h1"], "left_semi")
        each = places.filter("h0 is null").unionByName(rest)
        found.append(each.select(*KEY, "lo", "hi"))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return merged_spans(spans)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(row key, lo, hi): stretches that overlap or touch as one."""
    before = Over.partitionBy(*KEY).orderBy("lo", "hi").rowsBetween(Over.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("long")
    until = Over.partitionBy(*KEY).orderBy("lo", "hi").rowsBetween(Over.unboundedPreceding, 0)
    marked = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(until))
    return marked.groupBy(*KEY, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, the other words joined by blanks); lo and hi are stretches that neither overlap nor touch."""
    n = gone = 0
    kept: list[bytes] = []
    for w in [words([text])] if len(text) <= PIECE_BYTES else (w for w, _ in pieces(text, 0)):
        size = len(w.start)
        a, b = np.clip(lo - n, 0, size), np.clip(hi - n, 0, size)
        a, b = a[b > a], b[b > a]
        # what stands between the stretches
        begin, end = np.concatenate([[0], b]), np.concatenate([a, [size]])
        kept += [w.buf[w.start[i] : w.end[j - 1]].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True) if i < j]
        n += size
        gone += int((b - a).sum())
    return n, gone, b" ".join(kept)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, spans = batch.column("_text"), batch.column("_spans")
        done = []
        for i in range(len(batch)):
            own = np.array([(s["lo"], s["hi"]) for s in spans[i].as_py() or []], np.int64).reshape(-1, 2)
            done.append(cut(text[i].as_py() or b"", own[:, 0], own[:, 1]))
        n, gone, kept = zip(*done, strict=True) if done else ((), (), ())
        arrays = [batch.column(k) for k in (*KEY, "_id")]
        arrays += [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, [*KEY, "_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, hot_from: int = HOT
) -> DataFrame:
    """The row key, _id, n_words, n_removed and kept_text of each row.

    Each word goes that is covered by `window` consecutive words of its text which also start
    anywhere else, in the same text or another; all copies go, and windows are judged on
    the input. A null text has no words and keeps the empty text; rows that repeat are texts of
    their own, and so copies; very long texts are read in pieces, and wholly. An empty table gives an
    empty result. Other columns of docs play no part, whatever their names.
    """
    workers(docs.sparkSession)
    own = keyed(docs, _id=column(id_col), _text=column(text_col).cast("binary"))
    with tables(docs.sparkSession):
        spans = repeat_spans(own, window, prefixes, hot_from)
        spans = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
        spans = materialize(spans, "sub-spans", outlives=True)
    key = F.struct(*KEY)
    maybe, sure = split_by_keys(own, key, spans.select(key.alias("_k")))
    none = F.expr("cast(null as array<struct<lo:bigint,hi:bigint>>)").alias("_spans")
    both = maybe.join(spans, [*KEY], "left").unionByName(sure.select("*", none))
    id_type = own.schema["_id"].dataType.simpleString()
    return both.select(*KEY, "_id", "_text", "_spans").mapInArrow(
        _cut_batches, f"{KEY[0]} long, {KEY[1]} long, _id {id_type}, n_words long, n_removed long, kept_text string"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 35 words that occur anywhere else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select(
        F.col("_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


#: Every window spelled out, which is what the trees avoid.
OP4_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT place, w, unnest(range(1, len(w) - 33)) AS i FROM split),
windows AS (SELECT place, i, array_to_string(w[i:i + 34], ' ') AS g FROM starts),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT place, i + k AS p FROM windows JOIN repeated USING (g), range(35) r(k)),
each AS (SELECT place, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT place, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (place, p) GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (place)
"""
