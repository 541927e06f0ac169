"""Tables in the shared folder, row keys, column names and bounded bitmaps.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
again: unlike a local checkpoint it outlives any executor, and its real size is
known to the adaptive planner. All tables of an application stand in one folder, which
release() deletes; tables() deletes those of a block of code.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Bits of a candidate bitmap: 4 MB however much data there is.
BITMAP_BITS = 1 << 25
#: Bytes of an Arrow batch that goes to a Python worker, unless the session has its own setting.
ARROW_BYTES = 4 << 20
#: Keys with more than one in HOT of all rows are hot, so there are fewer than HOT of them.
HOT = 1 << 16

_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkpact-"))
    return sc.getCheckpointDir().rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkpact-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made[: len(_made) - outlives]:
        made.append(path)
    return path


@contextlib.contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate tables are deleted at its end, but for those made to outlive it.

    What the block returns must not read the others any more.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for path in made:
            drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, once no result of an operator is read any more."""
    drop_path(spark, _folder(spark))


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """df, written to the shared folder and read again. outlives: it stays when the innermost tables() block ends."""
    spark = df.sparkSession
    path = new_path(spark, name, outlives)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*written: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def workers(spark: SparkSession) -> None:
    """Makes the session ready for Python workers: the package's sources, and batches of bounded size."""
    ship(spark)
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def column(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Where a row lies: file and row index in it.
KEY = ("_rk_file", "_rk_row")


def _is_scan(df: DataFrame) -> bool:
    """Whether df's rows are rows of files, none of them twice: a relation below projections and filters."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def _scanned(df: DataFrame) -> DataFrame | None:
    """df with a row key by file and position, None where rows have no such place."""
    if not _is_scan(df):
        return None
    try:
        place = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(place["file_path"]).alias(KEY[0]), place["row_index"].alias(KEY[1]))
    except AnalysisException:
        return None


def keyed(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns of df and two long columns that name each row, the same at every evaluation.

    Rows of a file scan are named by file and position. Anything else, where rows may
    come from one place and be several, is first written to the shared folder, which
    gives each row a position of its own.
    """
    own = df.select(*[c.alias(n) for n, c in columns.items()])
    return _scanned(own) or _scanned(materialize(own, "rows"))


class Flat:
    """A table whose columns are called c0, c1 and so on, so that no name can clash, with row keys."""

    def __init__(self, docs: DataFrame, keys: bool = True):
        self.names = docs.columns
        self.own = [f"c{i}" for i in range(len(self.names))]
        rows = docs.toDF(*self.own)
        self.rows = keyed(rows, **{c: F.col(c) for c in self.own}) if keys else rows

    def name(self, wanted: str) -> str:
        """The present name of a column: one that has this name, else the only one that has it but for case."""
        at = [i for i, n in enumerate(self.names) if n == wanted] or [i for i, n in enumerate(self.names) if n.lower() == wanted.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are called {wanted!r}")
        return self.own[at[0]]

    def restored(self, rows: DataFrame, *more: Column) -> DataFrame:
        """rows with the former names, and further columns; of the former, those whose names are given again give way."""
        added = rows.select(*self.own, *more).columns[len(self.own) :]
        stay = [i for i, n in enumerate(self.names) if n not in added]
        return rows.select(*[self.own[i] for i in stay], *more).toDF(*[self.names[i] for i in stay], *added)


def bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of `bits` bits with those set that the low bits of the long `key` name.

    Its words are made on the executors; what comes to the driver is bounded by
    `bits` alone.
    """
    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int({key} & 63))")).alias("b")
    )
    out = np.zeros(max(1, bits // 64), np.uint64)
    for batch in words.toArrow().to_batches():
        at = batch.column("w").to_numpy(zero_copy_only=False)
        out[at] = batch.column("b").to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key surely is not).

    `keys` has one column. A bitmap table of at most bits/64 rows is broadcast;
    rows that it rules out need no shuffle. Null keys are ruled out.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    own = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits)).alias("_bm_slot"))
    words = own.groupBy(F.expr("shiftright(_bm_slot, 6)").alias("_bm_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_bm_slot & 63))")).alias("_bm_bits")
    )
    marked = df.withColumn("_bm_slot", slot).withColumn("_bm_word", F.expr("shiftright(_bm_slot, 6)"))
    marked = marked.join(F.broadcast(words), "_bm_word", "left")
    hit = F.expr("coalesce(shiftright(_bm_bits, int(_bm_slot & 63)) & 1L, 0L) = 1L")
    return marked.filter(hit).select(df.columns), marked.filter(~hit).select(df.columns)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with table, which has one row a key and tells in n how many rows have that key.

    Keys that more than one in HOT of all rows share are fewer than HOT, so their part of the
    table is broadcast and no task gets all their rows; only the others are shuffled.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    least = max((total or 0) // HOT, 256)
    if (most or 0) <= least:
        return rows.join(table, key)
    hot = F.col(n) > least
    many = F.broadcast(table.filter(hot))
    rest = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti")
    return rows.join(many, key).unionByName(rest.join(table.filter(~hot), key))


def counted_parts(rows: DataFrame, table: DataFrame, key: str, n: str) -> list[tuple[DataFrame, DataFrame]]:
    """rows in parts, each with its part of the table, as join_counted joins them: a hot part, whose table is to be broadcast, and the rest."""
    total, most = table.agg(F.sum(n), F.max(n)).first()
    least = max((total or 0) // HOT, 256)
    if (most or 0) <= least:
        return [(rows, table)]
    many = table.filter(F.col(n) > least)
    keys = F.broadcast(many.select(key))
    return [(rows.join(keys, key, "left_semi"), F.broadcast(many)), (rows.join(keys, key, "left_anti"), table.filter(F.col(n) <= least))]
