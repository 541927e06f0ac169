"""SimHash near-dedup of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

A wide SimHash of the set, WORDS_ words of bits, tells apart what 64 bits can't: at 0.8 two texts differ in 39 of
256 bits on average, in more than RADIUS with probability 5e-6. Small sets vary more and have SMALL_RADIUS. Texts
meet in buckets, which here are bands of ROWS least shingle hashes: two texts of similarity s share none of BANDS
bands with probability (1 - s^ROWS)^BANDS, 6e-7 at 0.8. Within a bucket they are compared by bit planes, as in
op9, and pairs within the radius are judged exactly by their sets. Texts with equal sets are one node.

Only pairs of different components need judging, and few of them: in turns, each bucket of BUCKET nodes at most
names leaders, the nodes with the most others within the radius, no two of which are near each other at first. All of a
leader's pairs are judged, after which it leaves the bucket. Hubs are found at once, so groups of copies
become one component in a turn. From the second turn on, the sets of a bucket's nodes that are still apart go to the bucket, SETS
hashes at most, and all pairs are judged there: no pair is a row. With more hashes the bucket goes on in turns, of which
turn k lets NEAR_LEADERS^k leaders be near each other, so the third judges all pairs that are still apart. A larger bucket first judges its nodes with the one that is nearest to the majority of
a sample's bits, and is then dealt anew by bands of other hashes, so that texts which share no more than a
frequent passage part. What is large after LEVELS such turns is compared, but for its largest component's own
pairs, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import without_rows
from .shared import KEY, Flat, column, counted_parts, drop, join_counted, keyed, materialize, split_by_keys, tables, workers
from .simhash import PIECE_BYTES, _shingles, _union, majority, members, near_rows, piece_hashes
from .textops import BLOCK_BYTES, blocks, byte_sizes, mixed, words, xxh64

SHINGLE = 5
BANDS, ROWS = 20, 3
#: Words of a fingerprint, and bits that near copies may differ in; sets of less than SMALL shingles may in more.
WORDS_, RADIUS, SMALL, SMALL_RADIUS = 4, 64, 40, 80
#: Nodes of a bucket all of whose pairs are judged, and that name leaders; rows of small buckets that are shifted together.
FEW, BUCKET, CHUNK = 8, 1 << 11, 1 << 15
#: Leaders near a leader in the second turn, and nodes of a large bucket whose majority chooses its leader.
NEAR_LEADERS, SAMPLE = 64, 64
#: Shingle hashes of a bucket whose sets are compared in one task (16 MB).
SETS = 1 << 21
#: Nodes of a bucket that are compared with all others at a time.
TOGETHER = 256
#: Links that a task contracts at a time (16 MB).
LINKS = 1 << 20
#: Times that large buckets are dealt anew.
LEVELS = 3

_SIM = [f"s{k}" for k in range(WORDS_)]


def _multipliers(level: int) -> np.ndarray:
    """An odd multiplier for each of a level's least hashes."""
    at = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(level * BANDS * ROWS)
    return mixed(at * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and how many each text has."""
    w = words([t.lower() if len(t) <= PIECE_BYTES else b"" for t in texts])
    start, end, number = _shingles(w, n)
    of, h = [np.repeat(np.arange(len(texts)), number)], [xxh64(w.buf, start, end)]
    for i in (i for i, t in enumerate(texts) if len(t) > PIECE_BYTES):
        for part in piece_hashes(texts[i].lower(), n):
            h.append(np.unique(part))
            of.append(np.full(len(h[-1]), i))
    of, h = np.concatenate(of), np.concatenate(h)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def set_hashes(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of each set of texts that have shingles."""
    number = number[number > 0]
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(mixed(h), np.cumsum(number) - number) + number.astype(np.uint64)) if len(number) else np.zeros(0, np.uint64)


def band_keys(h: np.ndarray, number: np.ndarray, level: int = 0) -> np.ndarray:
    """The keys of the bands of texts that have shingles."""
    number = number[number > 0]
    first = np.cumsum(number) - number
    keys = np.zeros((len(number), BANDS), np.uint64)
    if not len(number):
        return keys
    by = _multipliers(level)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(number), b + 1, np.uint64)
            for r in range(ROWS):
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(h * by[b * ROWS + r], first))
            keys[:, b] = key
    return keys


def wide_prints(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """WORDS_ words of SimHash for each text."""
    with np.errstate(over="ignore"):
        return np.stack([majority(mixed(h * np.uint64(2 * k + 1)) if k else h, number) for k in range(WORDS_)], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns before _text of some rows, their shingle hashes and the number of each row."""
    for batch in batches:
        text = batch.column("_text")
        for lo, hi in blocks(byte_sizes(text), BLOCK_BYTES):
            h, number = shingle_sets([b"" if t is None else t for t in text.slice(lo, hi - lo).to_pylist()])
            yield [c.slice(lo, hi - lo) for c in batch.columns[:-1]], batch.schema.names[:-1], h, number


def _lists(values: np.ndarray, number: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, names, h, number in _blocks(batches):
        node = np.zeros(len(number), np.uint64)
        node[number > 0] = set_hashes(h, number)
        sim = wide_prints(h, number).view(np.int64)
        out = [pa.array(node.view(np.int64)), pa.array(number.astype(np.int64)), *(pa.array(sim[:, k].copy()) for k in range(WORDS_))]
        bands = _lists(band_keys(h, number).ravel(), (number > 0) * BANDS)
        yield pa.RecordBatch.from_arrays([*own, *out, bands], [*names, "_fp", "_n", *_SIM, "_bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, names, h, number in _blocks(batches):
        yield pa.RecordBatch.from_arrays([*own, _lists(h, number)], [*names, "_set"])


def _band_batches(level: int):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, names, h, number in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*own, _lists(band_keys(h, number, level).ravel(), (number > 0) * BANDS)], [*names, "_bands"])

    return bands


def dense_rows(fp: np.ndarray, comp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one bucket's nodes of different components that differ in `radius` bits at most.

    Each node outside the largest component is laid over all bit planes at once: a block holds its distances to 64 others,
    in carry-save counters that start so that the count after `radius` overflows. Blocks all of whose distances have
    overflowed are abandoned.
    """
    n = len(fp)
    names, of, size = np.unique(comp, return_inverse=True, return_counts=True)
    main = of == size.argmax()
    few = np.flatnonzero(~main)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    words_ = (n + 63) // 64
    packed = np.zeros((bits.shape[1], words_ * 8), np.uint8)
    packed[:, : (n + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = packed.view(np.uint64)
    every = np.uint64(2**64 - 1)
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    beyond = np.zeros(words_, np.uint64)
    if n % 64:
        beyond[-1] = every << np.uint64(n % 64)
    for lo in range(0, len(few), TOGETHER):
        rows = few[lo : lo + TOGETHER]
        own = np.where(bits[rows] > 0, every, np.uint64(0))
        at, word = (x.ravel() for x in np.indices((len(rows), words_)))
        over = np.tile(beyond, len(rows))
        counters = [np.full(len(at), every if start >> k & 1 else np.uint64(0)) for k in range(width)]
        for k in range(len(planes)):
            carry = planes[k][word] ^ own[at, k]
            for c in counters:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if k % 16 == 15:
                alive = np.flatnonzero(~over)
                if 2 * len(alive) < len(at):
                    at, word, over, counters = at[alive], word[alive], over[alive], [c[alive] for c in counters]
                if not len(at):
                    break
        where, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = rows[at[where]], word[where] * 64 + bit
        # both of a pair may be outside the largest component
        keep = main[j] | (i < j)
        yield i[keep], j[keep]


def near_pairs(bucket: np.ndarray, sim: np.ndarray, n: np.ndarray, comp: np.ndarray, turn: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket to be judged in a turn, and the rows all of whose pairs are among them.

    They are of different components and within the radius, and their sizes allow a similarity of 0.8. Rows are sorted by bucket.
    """
    if not len(bucket):
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.diff(edge)
    small = np.flatnonzero(np.repeat(size <= few, size))
    found = [_fitting(small[i], small[j], sim, n, comp)[:2] for i, j in near_rows(bucket[small], sim[small], SMALL_RADIUS)]
    done = [small]
    for lo, hi in zip(edge[:-1][size > few].tolist(), edge[1:][size > few].tolist(), strict=True):
        for leader, others in leaders(sim[lo:hi], n[lo:hi], comp[lo:hi], turn):
            found.append((np.full(len(others), lo + leader), lo + others))
            done.append(np.array([lo + leader]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j, np.concatenate(done)


def leaders(sim: np.ndarray, n: np.ndarray, comp: np.ndarray, turn: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one bucket, those with the most rows near them first, and all rows near each: before a leader, fewer than NEAR_LEADERS**turn others are near it."""
    degree, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for i, j in dense_rows(sim, comp, SMALL_RADIUS):
        i, j, d = _fitting(i, j, sim, n, comp)
        for x in (i, j):
            degree += np.bincount(x, minlength=len(n))
            total += np.bincount(x, weights=d, minlength=len(n)).astype(np.int64)
    covered = np.zeros(len(n), np.int64)
    every = np.arange(len(n))
    for row in np.lexsort((total, -degree))[: np.count_nonzero(degree)].tolist():
        if covered[row] < NEAR_LEADERS**turn:
            _, others, _ = _fitting(np.full(len(n), row), every, sim, n, comp)
            covered[others] += 1
            yield row, others


def _fitting(i: np.ndarray, j: np.ndarray, sim: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs that may be similar by their components and sizes, and their distances."""
    least = np.minimum(n[i], n[j])
    keep = (comp[i] != comp[j]) & (5 * least >= 4 * np.maximum(n[i], n[j]))
    i, j, least = i[keep], j[keep], least[keep]
    d = np.bitwise_count(sim[i] ^ sim[j]).sum(axis=1)
    near = d <= np.where(least < SMALL, SMALL_RADIUS, RADIUS)
    return i[near], j[near], d[near]


def _pair_batches(turn: int):
    def pairs(rows: dict) -> pa.RecordBatch:
        i, j, done = near_pairs(rows["bucket"], rows["sim"], rows["n"], rows["comp"], turn)
        a, b = rows["node"][i], rows["node"][j]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        # rows that are done: their bucket, and no second node
        first = np.concatenate([both[:, 0], rows["node"][done]])
        is_pair = np.arange(len(first)) < len(both)
        second = np.concatenate([both[:, 1], np.zeros(len(done), np.int64)])
        bucket = np.concatenate([np.zeros(len(both), np.int64), rows["bucket"][done]])
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=~is_pair), pa.array(bucket, mask=is_pair)], ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {}
        for batch in batches:
            new = {k: batch.column(k).to_numpy() for k in ("bucket", "node", "n", "comp")}
            new["sim"] = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in _SIM], axis=1)
            rows = {k: np.concatenate([rows[k], v]) for k, v in new.items()} if rows else new
            while len(rows["bucket"]) >= CHUNK:
                cut = int(np.searchsorted(rows["bucket"], rows["bucket"][min(len(rows["bucket"]), 2 * CHUNK) - 1]))  # the last bucket may go on
                if not cut:
                    break
                yield pairs({k: v[:cut] for k, v in rows.items()})
                rows = {k: v[cut:] for k, v in rows.items()}
        if rows and len(rows["bucket"]):
            yield pairs(rows)

    return run


def set_links(sets: np.ndarray, sim: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one bucket whose components are those of all similar pairs within the radius; sets: the n hashes of each row in turn."""
    at = np.concatenate([[0], np.cumsum(n)])
    _, number = np.unique(sets, return_inverse=True)
    # the first row of each row's component so far
    label = np.unique(comp, return_index=True, return_inverse=True)
    label = label[1][label[2]]
    own = np.zeros(len(sets), bool)
    found = [(np.zeros(0, np.int64),) * 2]
    for i in range(len(n) - 1):
        later = np.arange(i + 1, len(n))
        _, j, _ = _fitting(np.full(len(later), i), later, sim, n, label)
        if not len(j):
            continue
        own[number[at[i] : at[i + 1]]] = True
        first = np.cumsum(n[j]) - n[j]
        both = np.add.reduceat(own[number[np.repeat(at[j] - first, n[j]) + np.arange(n[j].sum())]], first, dtype=np.int64)
        own[number[at[i] : at[i + 1]]] = False
        j = j[9 * both >= 4 * (n[i] + n[j])]
        if len(j):
            found.append((np.full(len(j), i), j))
            _union(label, *found[-1])
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _set_link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket, whose rows follow each other; one bucket is held at a time."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        node, n, comp = (rows[k].to_numpy() for k in ("node", "n", "comp"))
        sim = np.stack([rows[k].to_numpy().view(np.uint64) for k in _SIM], axis=1)
        i, j = set_links(pa.compute.list_flatten(rows["_set"]).to_numpy(), sim, n, comp)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if len(b)):
        bucket = batch.column("bucket").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and held[0].column("bucket")[0].as_py() != bucket[lo]:
                yield links(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield links(held)


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with the components of the given ones, LINKS of them at a time: each node with the smallest that it reaches."""

    def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        _union(label, at[: len(a)], at[len(a) :])
        i = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[i]]), pa.array(nodes[i])], ["a", "b"])

    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()])
        if len(a) >= LINKS:
            yield forest(a, b)
            a = b = np.zeros(0, np.int64)
    if len(a):
        yield forest(a, b)


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the components of the given ones, each task's as stars, so that few turns of stars are left to do."""
    return links.distinct().mapInArrow(_forest_batches, "a long, b long")


def _majority_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's sampled fingerprints, the bits that most of them have."""
    for batch in (b for b in batches if len(b)):
        own = [np.array([[s[k] for k in _SIM] for s in sample], np.int64) for sample in batch.column("sample").to_pylist()]
        bits = [2 * np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0) > len(x) for x in own]
        words_ = np.packbits(np.array(bits).reshape(len(own), -1), axis=1, bitorder="little").view(np.int64).reshape(len(own), WORDS_)
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("m"), *(pa.array(words_[:, k].copy()) for k in range(WORDS_))], ["bucket", "m", *[f"c_{k}" for k in _SIM]])


def _distance(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in _SIM), F.lit(0))


def _within(x: str, y: str) -> Column:
    """Whether two nodes may be similar, by their components, sizes and fingerprints."""
    differ = _distance(f"{x}.", f"{y}.")
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & (5 * small >= 4 * large) & (differ <= F.when(small < SMALL, SMALL_RADIUS).otherwise(RADIUS))


class Similar:
    """Finds the links between nodes (_fp) of prints, whose texts are in `own`."""

    def __init__(self, prints: DataFrame, own: DataFrame):
        self.own = own
        place = F.min(F.struct(*KEY)).alias("place")
        nodes = prints.groupBy(F.col("_fp").alias("node")).agg(place, *[F.any_value(c).alias(c.strip("_")) for c in ("_n", *_SIM, "_bands")])
        self.nodes = materialize(nodes, "near-nodes")
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(node, _text) of some nodes (node, place), each from one of its rows."""
        # few long columns, from any number of tasks: in files of the advisory size
        need = materialize(nodes.select("node", *[F.col(f"place.{k}").alias(k) for k in KEY]).hint("rebalance"), "near-need")
        texts, _ = split_by_keys(self.own.select(*KEY, "_text"), F.xxhash64(*KEY), need.select(F.xxhash64(*KEY)))
        return texts.join(need, [*KEY]).select("node", "_text")

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """(node, _set) of some nodes (node)."""
        texts = self._texts(nodes.join(self.nodes, "node"))
        return materialize(texts.mapInArrow(_set_batches, "node long, _set array<long>"), "near-sets")

    def judge(self, pairs: DataFrame) -> bool:
        """Adds to the links those pairs (a, b) whose sets are similar; none is judged twice. Whether there are any."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        if self.links is not None and pairs.isEmpty():
            return False
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        need = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("m"))
        sets = self._sets(need)
        own = {}
        for side in ("a", "b"):
            counted = sets.join(pairs.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("m")), "node")
            own[side] = counted.select(F.col("node").alias(side), F.col("_set").alias(f"_{side}"), "m")
        # parted by b before they are joined, so that no pair meets the set of a twice
        joined = [join_counted(some, own["a"], "a", "m").drop("m").join(table, "b").drop("m") for some, table in counted_parts(pairs, own["b"], "b", "m")]
        pairs = joined[0] if len(joined) == 1 else joined[0].unionByName(joined[1])
        both = F.size(F.array_intersect("_a", "_b"))
        # both / (a + b - both) >= 4 / 5
        found = pairs.filter(9 * both >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")
        found = materialize(found, "near-links")
        drop(sets)
        self.links = found if self.links is None else self.links.unionByName(found)
        return not found.isEmpty()

    def labels(self) -> DataFrame:
        """(node, label): the component so far of each node that has a link."""
        return materialize(connected_components(contracted(self.links), "a", "b"), "near-labels")

    def labelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows (node) with comp, the component of each by labels."""
        both = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        return materialize(both.select(*rows.columns), "near-labelled")

    def open(self, rows: DataFrame) -> DataFrame:
        """Those rows whose buckets hold several components, with m, the nodes of the bucket, and w, the hashes of their sets."""
        several = rows.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")
        )
        several = materialize(several.filter("lo <> hi").select("bucket", "m", "w").hint("rebalance"), "near-several")
        return materialize(join_counted(rows.drop("m", "w"), several, "bucket", "m"), "near-open")

    def inside(self, rows: DataFrame) -> bool:
        """Adds to the links those that similar pairs of buckets of BUCKET nodes and SETS hashes at most make. Whether there are any."""
        sets = self._sets(rows.select("node").distinct())
        own = rows.select("bucket", "node", "n", "comp", *_SIM).join(sets, "node")
        dealt = own.repartition("bucket").sortWithinPartitions("bucket")
        found = materialize(dealt.mapInArrow(_set_link_batches, "a long, b long").distinct(), "near-links")
        drop(sets)
        self.links = found if self.links is None else self.links.unionByName(found)
        return not found.isEmpty()

    def compare(self, rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """(pairs to be judged, rows (bucket, node) that have no others left) of buckets of BUCKET nodes at most."""
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
        found = dealt.select("bucket", "node", "n", "comp", *_SIM).mapInArrow(_pair_batches(turn), "a long, b long, bucket long")
        found = materialize(found, "near-found")
        return found.filter("b is not null").select("a", "b"), found.filter("b is null").select("bucket", F.col("a").alias("node"))

    def lead(self, rows: DataFrame) -> DataFrame:
        """Pairs of a large bucket's leader with its other nodes: it is the one nearest to the majority of a sample's bits."""
        h = F.pmod(F.xxhash64("bucket", "node", F.lit("lead")), F.lit(1 << 40))
        some = rows.filter(h <= (1 << 40) * (2 * SAMPLE) / F.col("m")).groupBy("bucket").agg(F.collect_list(F.struct(*_SIM)).alias("sample"), F.first("m").alias("m"))
        centres = materialize(some.mapInArrow(_majority_batches, "bucket long, m long, " + ", ".join(f"c_{k} long" for k in _SIM)), "near-centres")
        near = join_counted(rows.drop("m", "w"), centres, "bucket", "m")
        best = F.min(F.struct(_distance("", "c_").alias("d"), "node", "n", "comp", *_SIM)).alias("l")
        leader = near.groupBy("bucket").agg(best, F.count(F.lit(1)).alias("m")).select("bucket", "m", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("node", "n", "comp", *_SIM)])
        both = join_counted(rows.drop("m", "w"), materialize(leader, "near-leaders"), "bucket", "m")
        pair = both.select(F.struct("node", "n", "comp", *_SIM).alias("x"), F.struct(*[F.col(f"l_{c}").alias(c) for c in ("node", "n", "comp", *_SIM)]).alias("y"))
        return pair.filter(_within("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def rest(self, rows: DataFrame) -> DataFrame:
        """All pairs of a bucket's nodes outside its largest component with its nodes of other components.

        The bucket is dealt to chunks, and those few nodes go to each chunk.
        """
        sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"))
        main = materialize(main.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("long")), "near-main")
        both = materialize(join_counted(rows.drop("m", "w"), main, "bucket", "m"), "near-rest")
        few = both.filter("comp <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        all_ = both.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        found = few.alias("x").join(all_.alias("y"), F.expr("x.bucket = y.bucket and x.chunk = y.chunk") & _within("x", "y"))
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def deal(self, rows: DataFrame, level: int) -> DataFrame:
        """Nodes of large buckets in smaller ones, by bands of other hashes."""
        texts = self._texts(rows.select("node").distinct().join(self.nodes, "node"))
        bands = materialize(texts.mapInArrow(_band_batches(level), "node long, _bands array<long>"), "near-bands")
        own = rows.drop("m", "w").join(bands, "node").withColumn("_band", F.explode("_bands")).drop("_bands")
        return own.withColumn("bucket", F.xxhash64("bucket", "_band")).drop("_band")

    def run(self, largest: int, levels: int) -> DataFrame:
        """Links (a, b) whose components are those of all similar pairs that meet in a bucket."""
        rows = self.nodes.withColumn("comp", F.col("node")).select("node", "n", "comp", *_SIM, F.explode("bands").alias("bucket"))
        names = rows.columns
        level = turn = 0
        while True:
            rows = self.open(rows)
            small, large = rows.filter(F.col("m") <= largest), rows.filter(F.col("m") > largest)
            linked = False
            if turn:
                whole, small = small.filter(F.col("w") <= SETS), small.filter(F.col("w") > SETS)
                linked = not whole.isEmpty() and self.inside(whole)
            pairs, done = self.compare(small, turn)
            any_large = not large.isEmpty()
            if any_large:
                pairs = pairs.unionByName(self.rest(large) if level == levels else self.lead(large))
            elif pairs.isEmpty() and self.links is not None:
                return contracted(self.links)
            linked = self.judge(pairs) or linked
            left, large = small.join(done, ["bucket", "node"], "left_anti").select(*names), large.select(*names)
            if linked:
                labels = self.labels()
                left = self.labelled(left, labels)
                large = self.labelled(large, labels) if any_large and level < levels else large
            if any_large and level < levels:
                level += 1
                left = left.unionByName(self.deal(self.open(large), level).select(*names))
            rows, turn = left, turn + 1


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """The row key, _id, _fp, component_id and kept of each row, as simhash_groups has them.

    Words are lowered and split at white space; a text of less than five words is one shingle. Null
    texts and those without words are similar to each other alone. Long texts are hashed piece by
    piece and wholly. An empty table gives an empty result. Other columns of docs play no part, whatever
    their names.
    """
    workers(docs.sparkSession)
    own = keyed(docs, _id=column(id_col), _text=column(text_col).cast("binary")).select(*KEY, "_id", "_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1])
    sims = ", ".join(f"{k} long" for k in _SIM)
    prints = materialize(own.mapInArrow(_print_batches, f"{fields}, _fp long, _n long, {sims}, _bands array<long>"), "near-prints")
    return members(prints.select(*KEY, "_id", "_fp"), lambda _: Similar(prints, own).run(largest, levels))


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies; all columns stay as they are, whatever their names."""
    flat = Flat(docs)
    with tables(docs.sparkSession):
        gone = similar_groups(flat.rows, flat.name("doc_id"), flat.name("text")).filter("not kept")
        gone = materialize(gone.select(*KEY), "gone", outlives=True)
    return without_rows(flat, gone)
