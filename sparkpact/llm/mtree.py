"""Exact top-k by inner product: best-first search in a paged M-tree.

The largest inner products of a query are the nearest neighbours in a metric space: a
vector y gets one more coordinate, sqrt(M - |y|^2) with M the largest squared norm, a
query gets 0 there, and the squared distance is |q|^2 + M - 2 q.y.

The index is two tables. `nodes` has the routing entries of the upper levels: a node's
pivot, its covering radius, and its distance to its parent's pivot. A node with more than
a shard's rows is split: its rows go to the nearest of a few of its own rows, chosen by hash;
a vector that is frequent among these gets a child of its own, of radius 0, and rows that
nothing but their place tells apart are dealt out by place. `pages` has the lower levels of
each shard, one row a page: routing pages hold pivots, covering radii and distances to the
page's own pivot, leaves hold vectors and distances to the leaf's pivot.

A query first goes down to the shard of the nearest pivots, whose k-th distance bounds the
rest. Then it descends once more, level by level, to all shards whose ball comes as near. In
a shard each query works through its own queue of pages, the nearest ball first; queries that
have come to the same page are served together. An entry's distance is computed only if the
stored distances and the triangle inequality don't rule it out.

Distances only prune, with a margin for rounding; scores are exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import KEY, column, join_counted, keyed, materialize, workers

#: Rows of a shard at most, and its numbers (rows times dimensions); entries of a page; children of a node.
SHARD, NUMBERS, PAGE, FAN = 8192, 1 << 20, 128, 128
#: Below this, sums of products are exact in doubles.
_EXACT = 2.0**52
_LONG = 2**63


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exactly; sums outside the long range are cut off at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.array([[int(v) for v in row] for row in a.tolist()], object) @ np.array([[int(v) for v in row] for row in b.tolist()], object).T
    return np.clip(out, -_LONG, _LONG - 1).astype(np.int64)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    rest = np.maximum(most - (x * x).sum(axis=1), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to those of y; the number of entries is that of the result."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    return np.sqrt(np.maximum(square - 2.0 * (x @ y.T), 0.0))


class Tree:
    """The pages of a shard, built from above by dealing rows to pivots.

    x: lifted rows, all of one norm. A page is (vectors, distances to the page's pivot, covering
    radii, entries): a leaf's entries are rows, and its radii are none; those of others are pages. Vectors
    are not lifted: against a query, which has 0 there, the last coordinate plays no part.
    """

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.square = float((x[0] * x[0]).sum()) if len(x) else 0.0
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.x, self.page = x, page
        #: the root is the last page
        self._build(np.arange(len(x)), None)
        del self.x

    @classmethod
    def stored(cls, pages: list[tuple], square: float) -> Tree:
        tree = cls.__new__(cls)
        tree.pages, tree.square = pages, square
        return tree

    def _put(self, rows: np.ndarray, pivot: int | None, radii: np.ndarray, entries: np.ndarray) -> int:
        x = self.x
        stored = distances(x[rows], x[pivot : pivot + 1])[:, 0] if pivot is not None else np.zeros(len(rows))
        self.pages.append((np.ascontiguousarray(x[rows, :-1]), stored, radii, entries))
        return len(self.pages) - 1

    def _build(self, rows: np.ndarray, pivot: int | None) -> int:
        x = self.x
        if len(rows) <= self.page:
            return self._put(rows, pivot, np.zeros(0), rows)
        fan = min(self.page, math.ceil(len(rows) / self.page) + 1)
        pivots = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        near = np.full(len(rows), np.inf)
        own = np.zeros(len(rows), np.int64)
        for k, p in enumerate(pivots):
            d = distances(x[rows], x[p : p + 1])[:, 0]
            better = d < near
            near[better], own[better] = d[better], k
        chosen, radii, children = [], [], []
        for k, p in enumerate(pivots):
            g = np.flatnonzero(own == k)
            # rows that no pivot parts (equal rows, say) are parted by position
            for part in np.array_split(g, math.ceil(len(g) / self.page)) if len(g) == len(rows) else [g] if len(g) else []:
                chosen.append(p)
                radii.append(near[part].max())
                children.append(self._build(rows[part], p))
        return self._put(np.array(chosen), pivot, np.array(radii), np.array(children))

    def search(self, q: np.ndarray, k: int, bound: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(queries, rows) that are at least the k nearest rows of each query (not lifted) within its bound, ties at the
        k-th included, but not row skip[i] (-1: none); and how many distances were computed and pages visited.
        """
        base = self.square + (q * q).sum(axis=1)
        slack = 2e-6 * (1.0 + np.sqrt(base))
        bound = bound.copy()
        root = len(self.pages) - 1
        low = np.full((len(q), len(self.pages)), np.inf)
        low[:, root] = 0.0
        to_pivot = np.full(low.shape, np.nan)
        best = np.full((len(q), k), np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        computed = visited = 0
        everyone = np.arange(len(q))
        while True:
            turn = low.argmin(axis=1)
            least = low[everyone, turn]
            alive = np.flatnonzero((least < np.inf) & ~(least > bound + slack))
            if not len(alive):
                break
            low[alive, turn[alive]] = np.inf
            visited += len(alive)
            for page in np.unique(turn[alive]).tolist():
                who = alive[turn[alive] == page]
                vectors, stored, radii, entries = self.pages[page]
                leaf = not len(radii)
                # |d(entry, pivot) - d(q, pivot)| bounds d(entry, q) from below
                gap = np.abs(stored[None] - to_pivot[who, page][:, None])
                need = ~(gap > (bound + slack)[who][:, None] + (0.0 if leaf else radii[None]))
                used = np.flatnonzero(need.any(axis=0))
                if not len(used):
                    continue
                computed += len(who) * len(used)
                d = np.sqrt(np.maximum(base[who][:, None] - 2.0 * (q[who] @ vectors[used].T), 0.0))
                d[~need[:, used]] = np.inf
                if leaf:
                    d[entries[used][None] == skip[who][:, None]] = np.inf
                    both = np.concatenate([best[who], d], axis=1)
                    best[who] = np.partition(both, k - 1, axis=1)[:, :k]
                    bound[who] = np.minimum(bound[who], best[who].max(axis=1))
                    i, j = np.nonzero((d < np.inf) & ~(d > (bound + slack)[who][:, None]))
                    hits.append((who[i], entries[used][j], d[i, j]))
                else:
                    children = entries[used]
                    to_pivot[np.ix_(who, children)] = d
                    low[np.ix_(who, children)] = np.maximum(d - radii[used][None], 0.0)
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), computed, visited
        who, rows, d = (np.concatenate(x) for x in zip(*hits, strict=True))
        near = ~(d > (bound + slack)[who])
        return who[near], rows[near], computed, visited


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat) and len(flat[0]) else 0)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _number(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64)


def _pivots(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vectors of some rows, lifted, in a fixed order, and which of them occur more than once."""
    if not len(table):
        raise RuntimeError("a node without pivots: no hash of its rows fell below the threshold")
    x, count = np.unique(lifted(_matrix(table.column("v")), _number(table, "most")[0]), axis=0, return_counts=True)
    return x, count > 1


def _deal(rows: pa.Table, sample: pa.Table) -> pa.Table:
    """rows, each at the child of its nearest pivot; those equal to a frequent pivot at a child of their own."""
    if not len(rows):
        return rows.drop_columns(["salt"]).append_column("dist", pa.array([], pa.float64()))
    x = lifted(_matrix(rows.column("v")), _number(rows, "most")[0])
    pivots, frequent = _pivots(sample)
    d = distances(x, pivots)
    first = d.argmin(axis=1)
    same = frequent[first] & (x == pivots[first]).all(axis=1)
    child = [f"{i}=" if s else str(i) for i, s in zip(first.tolist(), same.tolist(), strict=True)]
    node = pc.binary_join_element_wise(rows.column("node"), pa.array(child), ".")
    out = rows.drop_columns(["salt"]).set_column(0, "node", node)
    return out.append_column("dist", pa.array(np.where(same, 0.0, d[np.arange(len(x)), first])))


def _children(sample: pa.Table) -> pa.Table:
    """The nodes that _deal() deals to, whether any row comes there or not."""
    pivots, frequent = _pivots(sample)
    parent = sample.column("node")[0].as_py()
    above = sample.column("above")[0].as_py()
    far = distances(pivots, np.array([above]))[:, 0] if above else np.full(len(pivots), np.nan)
    at = np.concatenate([np.arange(len(pivots)), np.flatnonzero(frequent)])
    names = [f"{parent}.{i}" for i in range(len(pivots))] + [f"{parent}.{i}=" for i in at[len(pivots) :].tolist()]
    return pa.table({"parent": pa.array([parent] * len(at)), "node": names, "pivot": _vectors(pivots[at]), "to_parent": far[at]})


_NODE = "parent string, node string, pivot array<double>, to_parent double"
_ROW = "node string, id long, place string, v array<double>, most double, dist double"
_PAGE = "node string, page int, n long, square double, vectors binary, stored binary, radii binary, entries binary, ids array<long>, places array<string>"


def _pages(rows: pa.Table) -> pa.Table:
    """The pages of one shard. The last is the root, and it names the shard's rows."""
    rows = rows.sort_by([("id", "ascending"), ("place", "ascending")])
    tree = Tree(lifted(_matrix(rows.column("v")), _number(rows, "most")[0]))
    n = len(tree.pages)
    last = [None] * (n - 1)
    return pa.table(
        {
            "node": pa.array([rows.column("node")[0].as_py()] * n),
            "page": pa.array(range(n), pa.int32()),
            "n": pa.array([len(p[3]) for p in tree.pages], pa.int64()),
            "square": pa.array([tree.square] * n),
            **{name: pa.array([np.ascontiguousarray(p[k]).tobytes() for p in tree.pages], pa.binary()) for k, name in enumerate(("vectors", "stored", "radii", "entries"))},
            "ids": pa.array([*last, rows.column("id").to_pylist()], pa.list_(pa.int64())),
            "places": pa.array([*last, rows.column("place").to_pylist()], pa.list_(pa.string())),
        }
    )


_EMPTY = {"query_id": pa.int64(), "place": pa.string(), "vec_id": pa.int64(), "score": pa.int64()}


def _search_shard(k: int):
    def search(queries: pa.Table, pages: pa.Table) -> pa.Table:
        """The k best of a shard's rows for each query; ties go to smaller ids."""
        out: dict[str, list] = {name: [] for name in _EMPTY}
        if len(queries) and len(pages):
            own = sorted(pages.to_pylist(), key=lambda p: p["page"])
            floats = lambda p, name: np.frombuffer(p[name], np.float64)
            read = [(floats(p, "vectors").reshape(p["n"], -1 if p["vectors"] else 0), floats(p, "stored"), floats(p, "radii"), np.frombuffer(p["entries"], np.int64)) for p in own]
            tree = Tree.stored(read, own[-1]["square"])
            ids = own[-1]["ids"]
            seat = {place: i for i, place in enumerate(own[-1]["places"])}
            q = _matrix(queries.column("v"))
            skip = np.array([seat.get(p, -1) for p in queries.column("place").to_pylist()])
            who, rows, _, _ = tree.search(q, k, _number(queries, "bound"), skip)
            vector = {}
            for vectors, _, radii, entries in read:
                if not len(radii):
                    vector.update(zip(entries.tolist(), vectors, strict=True))
            order = np.argsort(who, kind="stable")
            who, rows = who[order], rows[order]
            edge = np.searchsorted(who, np.arange(len(q) + 1))
            for i, (qid, place) in enumerate(zip(queries.column("id").to_pylist(), queries.column("place").to_pylist(), strict=True)):
                hit = rows[edge[i] : edge[i + 1]]
                if not len(hit):
                    continue
                score = dots(np.stack([vector[r] for r in hit.tolist()]), q[i : i + 1])[:, 0]
                best = np.lexsort((hit, -score))[:k]  # rows stand by id
                out["query_id"] += [qid] * len(best)
                out["place"] += [place] * len(best)
                out["vec_id"] += [ids[i] for i in hit[best].tolist()]
                out["score"] += score[best].tolist()
        return pa.table({name: pa.array(v, _EMPTY[name]) for name, v in out.items()})

    return search


def _route(all_within: bool):
    def route(queries: pa.Table, children: pa.Table) -> pa.Table:
        """queries at the child of the nearest pivot, or at all children whose balls their bounds reach."""
        names = ["node", "id", "place", "v", "bound", "dist", "open"]
        if not len(queries) or not len(children):
            return queries.select(names).slice(0, 0)
        children = children.sort_by("child")
        x = _matrix(queries.column("v"))
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        bound, above = _number(queries, "bound"), _number(queries, "dist")
        pivots, radius, stored = _matrix(children.column("pivot")), _number(children, "radius"), _number(children, "to_parent")
        slack = 2e-6 * (1.0 + np.sqrt((x * x).sum(axis=1) + (pivots[0] * pivots[0]).sum()))
        if all_within:
            reach = (bound + slack)[:, None] + radius[None]
            need = ~(np.abs(stored[None] - above[:, None]) > reach)
            used = np.flatnonzero(need.any(axis=0))
            d = np.full(need.shape, np.inf)
            d[:, used] = distances(x, pivots[used])
            i, j = np.nonzero(need & ~(d > reach))
        else:
            d = distances(x, pivots)
            i, j = np.arange(len(x)), d.argmin(axis=1)
        out = queries.select(names).take(pa.array(i))
        out = out.set_column(0, "node", children.column("child").take(pa.array(j)))
        out = out.set_column(5, "dist", pa.array(d[i, j]))
        return out.set_column(6, "open", children.column("open").take(pa.array(j)))

    return route


def _salted(rows: DataFrame, other: DataFrame, counts: DataFrame, most: Column) -> tuple:
    """Both sides by (node, salt): a node's rows are dealt to so many groups that each has `most` or so, and other goes to each.

    counts: (node, n, dim).
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("long")
    counts = counts.withColumn("salts", salts)
    left = join_counted(rows, counts.select("node", "n", "salts"), "node", "n").withColumn("salt", F.pmod(F.xxhash64("place", F.lit("salt")), F.col("salts")))
    right = other.join(counts.select("node", "salts"), "node").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    return left.drop("n", "salts"), right.drop("salts")


def _shard_rows(dim: Column) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(SHARD), F.floor(NUMBERS / F.greatest(dim, F.lit(1)))))


class Index:
    """The tables of an M-tree over rows (id long, place string, v array<double> of whole numbers); place names a row."""

    def __init__(self, rows: DataFrame, shard_rows=_shard_rows):
        self.shard_rows = shard_rows
        square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
        dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"))
        self.dims = materialize(dims.select("dim", "n", "most", F.col("dim").cast("string").alias("node")), "mt-dims")
        own = join_counted(rows.select("id", "place", "v", F.size("v").alias("dim")), self.dims.select("dim", "n", "most"), "dim", "n")
        own = own.select(F.col("dim").cast("string").alias("node"), "id", "place", "v", "most", F.lit(None).cast("double").alias("dist"))
        self._split(own)

    def _split(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        above = self.dims.select("node", F.lit(None).cast("array<double>").alias("pivot"))
        nodes: list[DataFrame] = []
        done: list[DataFrame] = []
        while True:
            counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max("dist").alias("radius"))
            counts = materialize(counts.withColumn("open", F.col("n") > self.shard_rows(F.col("dim"))), "mt-counts")
            if nodes:
                nodes[-1] = materialize(nodes[-1].join(counts.select("node", "n", "dim", "radius", "open"), "node"), "mt-nodes")
                above = nodes[-1].select("node", "pivot")
            marked = join_counted(rows, counts.select("node", "n", "dim", "open"), "node", "n")
            done.append(marked.filter("not open").select(*rows.columns))
            large = counts.filter("open")
            if large.isEmpty():
                break
            more = materialize(marked.filter("open"), "mt-open")
            parts = F.ceil(2 * F.col("n") / self.shard_rows(F.col("dim")))
            # rows that are all alike are dealt by place
            alike = F.col("node").endswith("=")
            numbered = F.pmod(F.xxhash64("place", F.lit("alike")), parts)
            equal = more.filter(alike).withColumn("node", F.concat_ws(".", "node", numbered)).select(*rows.columns)
            copies = large.filter(alike).join(above, "node").select(
                F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("k"), "pivot"
            )
            copies = copies.select("parent", F.concat_ws(".", "parent", "k").alias("node"), "pivot", F.lit(0.0).alias("to_parent"))
            # so few rows of each node that a hash chooses as pivots
            fan = F.least(F.lit(FAN), parts + 1)
            h = F.pmod(F.xxhash64("place", F.lit(f"pivot{len(nodes)}")), F.lit(1 << 40))
            some = more.filter(~alike).withColumn("_h", h).filter(F.col("_h") < (1 << 40) * (2 * fan + 64) / F.col("n"))
            some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("node").orderBy("_h", "place"))).filter(F.col("_rank") <= fan)
            some = materialize(some.join(above.withColumnRenamed("pivot", "above"), "node").select("node", "v", "most", "above"), "mt-pivots")
            nodes.append(some.groupBy("node").applyInArrow(_children, _NODE).unionByName(copies))
            left, right = _salted(more.filter(~alike).select("node", "id", "place", "v", "most"), some, large.filter(~alike), F.floor(NUMBERS / F.greatest("dim", F.lit(1))))
            left = left.select("node", "id", "place", "v", "most", "salt")
            dealt = left.groupBy("node", "salt").cogroup(right.groupBy("node", "salt")).applyInArrow(_deal, _ROW)
            rows = materialize(dealt.unionByName(equal), "mt-dealt")
        leaves = done[0]
        for d in done[1:]:
            leaves = leaves.unionByName(d)
        self.pages = materialize(leaves.groupBy("node").applyInArrow(_pages, _PAGE), "mt-pages")
        self.levels = nodes
        self.shards = self.pages.select("node").distinct()

    def _descend(self, queries: DataFrame, all_within: bool) -> DataFrame:
        """queries (id, place, v, bound) at the shards where they have to search: node."""
        open_ = self.dims.select("node", (F.col("n") > self.shard_rows(F.col("dim"))).alias("open"))
        at = queries.select(F.size("v").cast("string").alias("node"), "id", "place", "v", "bound", F.lit(None).cast("double").alias("dist"))
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(open_, "node")
        at = join_counted(at, sizes, "node", "m").drop("m")
        found = None
        for level in self.levels:
            at = materialize(at, "mt-at")
            here = at.filter("not open")
            found = here if found is None else found.unionByName(here)
            going = at.filter("open")
            counts = materialize(going.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")), "mt-going")
            children = level.select(F.col("node").alias("child"), F.col("parent").alias("node"), "pivot", "radius", "to_parent", "open")
            left, right = _salted(going, children, counts, F.floor(NUMBERS / F.greatest("dim", F.lit(FAN))))
            at = left.groupBy("node", "salt").cogroup(right.groupBy("node", "salt")).applyInArrow(
                _route(all_within), "node string, id long, place string, v array<double>, bound double, dist double, open boolean"
            )
        at = at.filter("not open")
        return (at if found is None else found.unionByName(at)).select("node", "id", "place", "v", "bound")

    def _search(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best rows of each (query, shard)."""
        counts = asked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
        left, right = _salted(asked, self.pages, materialize(counts, "mt-asked"), F.least(F.lit(4096), F.floor(NUMBERS / F.greatest("dim", F.lit(1)))))
        return left.groupBy("node", "salt").cogroup(right.groupBy("node", "salt")).applyInArrow(_search_shard(k), "query_id long, place string, vec_id long, score long")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        start = queries.select("id", "place", "v", F.lit(float("inf")).alias("bound"))
        home = materialize(self._descend(start, False), "mt-home")
        first = materialize(self._search(home, k), "mt-first")
        # the k-th score so far bounds all other shards
        kth = first.groupBy("place").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("place", F.try_element_at("s", F.lit(k)).alias("kth"))
        sizes = home.join(kth, "place", "left").select("node", "id", "place", "v", "kth", F.size("v").alias("dim"))
        of = self.dims.select("dim", "most")
        norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
        bound = F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), norm + F.col("most") - 2 * F.col("kth")))).otherwise(float("inf"))
        counted = sizes.groupBy("dim").agg(F.count(F.lit(1)).alias("m")).join(of, "dim")
        again = join_counted(sizes, counted, "dim", "m").select("id", "place", "v", bound.alias("bound"))
        self.reached = materialize(self._descend(again, True).join(home.select("node", "place"), ["node", "place"], "left_anti"), "mt-reached")
        second = self._search(self.reached, k)
        best = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        both = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows=_shard_rows) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the greatest inner products, but for its own row.

    rows and queries: (id long, place string, v array<double> of whole numbers); place names a row, and queries
    are rows. Vectors of different lengths don't meet. Ties go to the smaller id, then
    to either of rows that share it. Without rows or queries the result is empty.
    """
    workers(rows.sparkSession)
    return Index(rows, shard_rows).top_k(queries, k)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, place, v) of the rows that take part: floor(scale * x) of each component.

    Null vectors, and vectors that hold a null or a component that is not finite, take no
    part. Empty vectors do, among themselves; so do rows without an id, which lose ties. Rows that
    repeat are rows of their own. Other columns play no part, whatever their names.
    """
    own = keyed(table, id=column(id_col).cast("long"), x=column(vector_col))
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return own.filter(x.isNotNull() & finite).select("id", F.concat_ws("#", *KEY).alias("place"), whole.alias("v"))


def op3_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of the greatest inner products for every 50th embedding."""
    rows = materialize(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "mt-vectors")
    return top_k(rows, rows.filter("id % 50 = 0"))


#: Every query against every row, which is what the tree avoids.
OP3_SQL = """
WITH whole AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS e
               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.place <> c.place AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored)
SELECT query_id, n::INT AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
