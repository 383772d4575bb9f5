"""What the operators of this package share: reading tables, tables in the shared folder, row numbers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name` under `sf_dir`. Rows go to Python in batches of few rows from now on, as some have long texts or sets."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a Parquet file that a task decodes at once where long texts are read.
DECODED = 250


def few_decoded(spark: SparkSession) -> None:
    """From now on tasks decode few rows of a Parquet file at once: buffers for thousands of long texts, doubled as they fill, make an executor's heap grow."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(DECODED))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt over all cores before costly work on its rows; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: What a Python worker keeps from task to task, by operator.
KEPT: dict[str, object] = {}


def tidy(keep: str = "") -> None:
    """Gives memory back that a worker's earlier tasks left, but for what the operator `keep` keeps."""
    for name in [n for n in KEPT if n != keep]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with tidy() before and after: workers live longer than an operator's stage."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        tidy(keep)
        yield from run(batches)
        tidy(keep)

    return whole


def relieve(spark: SparkSession) -> None:
    """Gives memory back that the driver no longer needs, in Python and in the JVM, where the broadcasts and shuffles that nothing refers to any more end too."""
    tidy()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted column name, it or it with as many underscores as keep it from clashing with df's columns."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    out = f"{root.rstrip('/')}/quern-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, out)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_dir() when the driver ends; a session that is gone leaves it to the cluster's own cleaning."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table in the shared folder: later reads survive lost executors and don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}"
    df.write.parquet(path)
    _TABLES.append((path, out := spark.read.schema(df.schema).parquet(path)))
    return out


#: Tables of this driver in the shared folder, the latest last, and rows of numbers up to which a table is given to all executors.
_TABLES: list[tuple[str, DataFrame]] = []
TOLD = 1_000_000


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that are written within it when it ends, but for those that are put into the list it gives."""
    mark, kept = len(_TABLES), []
    try:
        yield kept
    finally:
        for path, df in _TABLES[mark:]:
            if not any(df is k for k in kept):
                _remove(spark, path)
        _TABLES[mark:] = [t for t in _TABLES[mark:] if any(t[1] is k for k in kept)]


def told(numbers: DataFrame) -> DataFrame:
    """A written table of few numbers a row, for a join: broadcast if its counted rows are few enough, else as it is."""
    return F.broadcast(numbers) if numbers.count() <= TOLD else numbers


#: Rows that a block of numbered rows is meant to hold; how many ranges, squared, a column is cut into at most.
BLOCK_OF, SIDE = 50_000, 64


def numbered(df: DataFrame, groups: list[str], out: str, blocks: int | None = None) -> DataFrame:
    """Adds `out`: 0-based row numbers within each combination of `groups`, gapless, in the order of the rows' hash.

    No group is gathered in one task: each is dealt into hash blocks, whose number follows the rows', numbered by themselves
    and shifted by the rows of the blocks before. Rows that agree in all columns are counted first and are one row until
    they get their numbers. Nulls are values like others. The caller picks an `out` that df doesn't have.
    """
    blocks = blocks or max(16, -(-df.count() // BLOCK_OF))
    whole = F.xxhash64(F.lit("block"), *df.columns)
    return in_blocks(df, groups, F.pmod(whole, F.lit(blocks)), [], out)


def numbered_by(df: DataFrame, groups: list[str], number: str, out: str, side: int | None = None) -> DataFrame:
    """Like numbered(), in the order of the column `number`, null first, with blocks that are ranges between its quantiles.

    Quantiles are those of the whole table, so far values make no block larger. Rows of one value are one block: they are
    as many as differ in other columns.
    """
    side = side or min(SIDE, max(4, int((df.count() / BLOCK_OF) ** 0.5) + 1))
    shares = [k / side**2 for k in range(1, side**2)]
    ends = df.agg(F.percentile_approx(number, shares, 20 * side**2)).first()[0] or []
    ends = sorted(set(ends))
    if not ends:
        return in_blocks(df, groups, F.lit(0).cast("long"), [F.asc_nulls_first(number)], out)
    ranges = [ends[k : k + side] for k in range(0, len(ends), side)]
    # first the range of bounds, then the place in it
    coarse = F.size(F.filter(F.array(*(F.lit(r[-1]) for r in ranges)), lambda e: e < F.col(number)))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in [*ranges, [ranges[-1][-1]]])), coarse + 1)
    block = coarse * side + F.size(F.filter(fine, lambda e: e < F.col(number)))
    return in_blocks(df, groups, F.coalesce(F.when(F.col(number).isNotNull(), block), F.lit(-1)).cast("long"), [F.asc_nulls_first(number)], out)


def in_blocks(df: DataFrame, groups: list[str], of_block: Column, order: list[Column], out: str, repeats: bool = True) -> DataFrame:
    """Adds `out`: row numbers in the order of (block, order) within each group. repeats: whether rows can agree in all columns."""
    block, before, times, nth, *others = fresh(df, "block", "before", "times", "nth", *(f"{g}_of" for g in groups), "block_of")
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(times)) if repeats else df.withColumn(times, F.lit(1).cast("long"))
    dealt = counted.withColumn(block, of_block)
    counts = dealt.groupBy(*groups, block).agg(F.sum(times).alias(before))
    ahead = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    keys = [*groups, block]
    renamed = shift.select(*(F.col(k).alias(o) for k, o in zip(keys, others, strict=True)), before)
    same = None
    for k, o in zip(keys, others, strict=True):
        test = F.col(k).eqNullSafe(F.col(o))
        same = test if same is None else same & test
    inside = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*df.columns)).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn(out, F.coalesce(F.sum(times).over(inside), F.lit(0)))
    joined = rows.join(renamed, same, "left").withColumn(out, F.col(out) + F.col(before))
    if repeats:  # in pieces, so that no array holds all copies of a row
        pieces = joined.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(1 << 16).cast("long"))))
        joined = pieces.withColumn(nth, F.explode(F.sequence(F.col(nth), F.least(F.col(nth) + (1 << 16), F.col(times)) - 1))).withColumn(out, F.col(out) + F.col(nth)).drop(nth)
    return joined.select(*df.columns, out)


def unit_draw(*parts: Column) -> Column:
    """A uniform draw in (0, 1), decided by the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
