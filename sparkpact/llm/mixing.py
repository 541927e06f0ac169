"""Mixing sources to target weights: entropy balancing, in DataFrame operations alone.

Targets: each source gets its weight's share of the mix, no more than `most` times
its own size, the excess reshared by weight (water filling, solved in closed form
by raising the level until no further source is full).

Rates: of all document rates between 0 and `most` whose words add up to the targets,
those of the greatest entropy relative to equal rates. By duality a document of size x
has the rate most / (1 + exp(-lambda * x / mean)): its odds are tilted exponentially, by one
multiplier a source. Newton steps on the convex dual find all multipliers at once. A step is
one aggregation over cells, which hold the counts of a source's documents by size: every
size up to SHORT is a cell, longer ones share cells 1.1 % wide. A cell has one rate.

Copies: a fold over a source's cells, from long to short, rounds each to whole copies and
hands on what rounding left. It sees SHORT + 64 * 20 cells a source at most. Which
documents of a cell get one copy more is decided by a hash of their ids and texts, so reruns agree:
those up to the cell's threshold. The threshold is found without sorting the cell, by
counts over the hashes' first bits. Of rows that repeat an id and a text the same is done by place.

Sums that decide anything are of whole numbers or decimals, so the order of rows doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import KEY, Flat, drop, materialize, tables

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sizes below this have cells of their own, larger ones 64 cells for each doubling.
SHORT = 4096
#: Newton steps at most, and the residual (of a target) that ends them; the fold evens out the rest.
STEPS, NEAR = 25, 1e-4
#: Rows of (source, size) that are broadcast at most; beyond, Spark chooses the join.
SMALL_CELLS = 1 << 19

WORD = r"[^\x20\x09-\x0D]+"


def _same_cell() -> Column:
    return F.expr("c.source <=> s.source and c.cell = s.cell")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with _k, each source's place by name (null last): a range sort, and the offsets of its partitions."""
    by_name = sizes.orderBy(F.col("source").isNull(), F.col("source").cast("string").cast("binary"))
    own = materialize(by_name.withColumn("_m", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_m", 33)
    # a row a partition of the sort
    before = own.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = own.withColumn("_p", part).join(F.broadcast(before), "_p")
    return own.withColumn("_k", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ratio: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    listed = materialize(_numbered(sizes).select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap")), "mix-weights")
    exact = lambda x: F.sum(x.cast("decimal(38,9)"))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    # the level only rises, and each turn finds one more full source at least
    level, full = 0.0, -1
    while True:
        is_full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, taken, rest = listed.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("_cap"))), exact(F.when(~is_full, F.col("_w")))).first()
        if n == full:
            break
        full, level = n, (total * ratio - float(taken or 0)) / float(rest) if rest else float("inf")
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w"))
    return listed.select("source", "source_size", target.alias("target"))


def document_rates(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """cells (source, cell, size, n) with each cell's rate and its source's residual, by Newton steps on the dual.

    A target of nothing, or of all that `most` allows, is met at the boundary: its
    multiplier would be infinite.
    """
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_m"))
    inf = float("inf")
    state = targets.alias("s").join(mean.alias("c"), same).select(
        "s.source", "source_size", "target",
        F.greatest("_m", F.lit(1e-9)).alias("_mean"),
        F.lit(0.0).alias("_l"), F.lit(-inf).alias("_lo"), F.lit(inf).alias("_hi"),
        F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("source_size") * (most - 1e-9), most).alias("_edge"),
        F.lit(0.0).alias("_off"), F.lit(False).alias("_done"),
    )
    state = materialize(state, "mix-state")
    x = F.col("size") / F.col("_mean")
    rate = F.coalesce("_edge", most / (1 + F.exp(-F.col("_l") * x)))
    for _ in range(STEPS):
        exact = lambda v: F.sum(v.cast("decimal(38,9)")).cast("double")
        got = exact(F.col("n") * F.col("size") * rate)
        slope = exact(F.col("n") * F.col("size") * x * rate * (1 - rate / most))
        sums = cells.alias("c").join(state.alias("s"), same).groupBy("s.source").agg(got.alias("_got"), slope.alias("_slope"))
        off = F.col("target") - F.col("_got")
        lo = F.when(off < 0, F.col("_lo")).otherwise(F.col("_l"))
        hi = F.when(off < 0, F.col("_l")).otherwise(F.col("_hi"))
        newton = F.col("_l") + off / F.when(F.col("_slope") > 0, F.col("_slope"))
        # outside the bracket, or where the sum is flat, halve the bracket or double the step
        halved = (
            F.when((lo > -inf) & (hi < inf), (lo + hi) / 2)
            .when(lo > -inf, F.greatest(lo * 2, lo + 1))
            .otherwise(F.least(hi * 2, hi - 1))
        )
        near = F.col("_edge").isNotNull() | (F.abs(off) <= F.col("target") * NEAR)
        new = state.alias("s").join(sums.alias("c"), same).select(
            "s.source", "source_size", "target", "_mean",
            F.when(near, F.col("_l")).when((newton > lo) & (newton < hi), newton).otherwise(halved).alias("_l"),
            lo.alias("_lo"), hi.alias("_hi"), "_edge", off.alias("_off"), near.alias("_done"),
        )
        last, state = state, materialize(new, "mix-state")
        drop(last)
        if state.filter("not _done").isEmpty():
            break
    return cells.alias("c").join(state.alias("s"), same).select(
        "c.source", "cell", "size", "n", "source_size", "target", rate.alias("rate"), F.when(F.col("_done"), F.col("_off")).otherwise(0.0).alias("_off")
    )


def cell_copies(rates: DataFrame, most: int) -> DataFrame:
    """rates with _take, the copies that all of a cell's documents get together."""
    one_cell = F.struct((-F.col("cell")).alias("c"), "size", "n", "rate")
    folded = rates.groupBy("source").agg(F.sort_array(F.collect_list(one_cell)).alias("_cells"), F.first("_off").alias("_off"))

    def one(acc, x):
        due = x["n"] * x["rate"] * x["size"] + acc["off"]
        take = F.when(x["size"] > 0, F.least(F.greatest(F.round(due / x["size"]), F.lit(0.0)), x["n"] * F.lit(float(most)))).otherwise(0.0)
        got = F.struct((-x["c"]).alias("cell"), take.cast("long").alias("take"))
        return F.struct((due - take * x["size"]).alias("off"), F.array_append(acc["out"], got).alias("out"))

    none = F.expr("cast(array() as array<struct<cell:bigint,take:bigint>>)")
    start = F.struct(F.col("_off").alias("off"), none.alias("out"))
    taken = folded.select("source", F.inline(F.aggregate("_cells", start, one)["out"])).withColumnRenamed("take", "_take")
    return rates.alias("c").join(taken.alias("s"), _same_cell()).select("c.source", "c.cell", "n", "source_size", "target", "_take")


def _nth(rows: DataFrame, wanted: DataFrame, h: str) -> DataFrame:
    """Of wanted (source, cell, _want): the value _upto of h that the _want-th row of the cell has, by h.

    _left tells how many of the rows that have just this value are wanted, and _of how many there are.
    """
    head = F.shiftright(h, 54)  # 1,024 signed heads, in the order of the hashes
    counts = rows.groupBy("source", "cell", head.alias("_head")).agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.alias("c").join(wanted.alias("s"), _same_cell()).select("c.*", "_want")
    run = F.sum("_m").over(Window.partitionBy("source", "cell").orderBy("_head"))
    cut = counts.withColumn("_rank", F.col("_want") - (run - F.col("_m"))).filter("_rank between 1 and _m")
    cut = materialize(cut.select("source", "cell", "_head", "_rank"), "mix-cut")
    of = rows.withColumn("_head", head).alias("c").join(cut.alias("s"), _same_cell() & (F.col("c._head") == F.col("s._head")))
    of = of.groupBy("c.source", "c.cell", F.col(f"c.{h}").alias("_upto"), "_rank").agg(F.count(F.lit(1)).alias("_of"))
    until = F.sum("_of").over(Window.partitionBy("source", "cell").orderBy("_upto"))
    found = of.withColumn("_left", F.col("_rank") - (until - F.col("_of"))).filter("_left between 1 and _of")
    return materialize(found.select("source", "cell", "_upto", "_left", "_of"), "mix-nth")


def thresholds(hashed: DataFrame, cells: DataFrame) -> DataFrame:
    """cells with _upto and _tie: one copy more get the rows (source, cell, _h, _t) with _h below _upto, and
    of those with _h = _upto all whose _t is up to _tie (all, if that is null).
    """
    some = cells.withColumn("_want", F.col("_take") % F.col("n")).filter("_want > 0").select("source", "cell", "_want")
    by_hash = _nth(hashed, some, "_h")
    ties = by_hash.filter("_left < _of")
    alike = hashed.alias("c").join(ties.alias("s"), _same_cell() & (F.col("c._h") == F.col("s._upto"))).select("c.*")
    by_place = _nth(alike, ties.select("source", "cell", F.col("_left").alias("_want")), "_t")
    both = by_hash.alias("c").join(by_place.alias("s"), _same_cell(), "left").select("c.source", "c.cell", "c._upto", F.col("s._upto").alias("_tie"))
    return cells.alias("c").join(both.alias("s"), _same_cell(), "left").select("c.source", "c.cell", "n", "source_size", "target", "_take", "_upto", "_tie")


def _mixed(flat: Flat, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], ratio: float, most: int) -> DataFrame:
    """The table's rows with _size, _source_size, _target and _copies."""
    id_, text = F.col(flat.name(id_col)), F.col(flat.name(text_col))
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(id_.cast("string"), text, F.lit("mix"))
    own = flat.rows.withColumns({"_source": F.col(flat.name(source_col)), "_size": words, "_h": h, "_t": F.xxhash64(*KEY)})
    cell = F.when(F.col("_size") < SHORT, F.col("_size")).otherwise(SHORT + F.floor(64 * F.log2(F.col("_size") / SHORT))).cast("long")
    own = own.withColumn("_cell", cell)
    with tables(flat.rows.sparkSession):
        short = materialize(own.select(F.col("_source").alias("source"), F.col("_cell").alias("cell"), F.col("_size").alias("size"), "_h", "_t"), "mix-sizes")
        cells = short.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
        cells = materialize(cells.withColumn("size", F.col("words") / F.col("n")), "mix-cells")
        sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
        targets = materialize(source_targets(sizes, weights, ratio, most), "mix-targets")
        rates = materialize(document_rates(cells, targets, float(most)), "mix-rates")
        take = materialize(cell_copies(rates, most), "mix-take")
        table = materialize(thresholds(short, take), "mix-thresholds", outlives=True)
    small = table.count() <= SMALL_CELLS
    # null-safe, or Spark would count the words once more to see that the cell is not null
    key = F.expr("c._source <=> s.source and c._cell <=> s.cell")
    more = (F.col("_h") < F.col("_upto")) | ((F.col("_h") == F.col("_upto")) & (F.col("_tie").isNull() | (F.col("_t") <= F.col("_tie"))))
    copies = F.floor(F.col("_take") / F.col("n")) + F.when(more, 1).otherwise(0)
    return own.alias("c").join((F.broadcast(table) if small else table).alias("s"), key).select(
        *[f"c.{c}" for c in flat.own], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.cast("long").alias("_copies")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    ratio: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """docs with _size, _source_size, _target and _copies (0 to most) for each row.

    A null text has no words, a null source is a source of its own, after the others.
    Sources without words have target 0, and documents without words no copies. Rows are chosen
    one by one, also those that share an id (or have none) or repeat another wholly. Very long
    texts are counted whole. An empty table gives an empty result. Columns of docs with the four
    names give way, others stay as they are.
    """
    flat = Flat(docs)
    return flat.restored(_mixed(flat, id_col, text_col, source_col, weights, ratio, most), *map(F.col, ("_size", "_source_size", "_target", "_copies")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay as they are, whatever their names."""
    flat = Flat(docs)
    taken = _mixed(flat, "doc_id", "text", "source", WEIGHTS, 1.5, 2).filter("_copies > 0")
    return flat.restored(taken.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")))
