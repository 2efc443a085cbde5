"""Intermediate tables in the folder that all executors share, and joins of
texts with keys that do not shuffle the texts whose key is not wanted."""

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a sieve.  It is broadcast, as at most so many / 64 rows of two
#: numbers (16 MB), however many keys there are: the more keys, the more rows
#: pass it by chance, up to all.
SIEVE = 1 << 25
_deleted: set[str] = set()


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a folder is made, in local mode only: on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="poolwright-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/stages-{sc.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back: it is computed once, its
    lineage is cut, and the loss of an executor does not lose it."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark)
    return spark.read.schema(df.schema).parquet(path)


def frugal(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows in this session from now on, so that
    a task holds few texts at once; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def _delete_at_end(spark: SparkSession) -> None:
    """Let the folder of this application go when the driver ends."""
    root = stage_root(spark)
    if root not in _deleted:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _deleted.add(root)


#: The place of a row: its file, by hash, and its number in there.
PLACE = ["_file", "_row"]


def placed(rows: DataFrame) -> DataFrame:
    """_file, _row and ``_all``, the row as a struct.  A place names one row and
    is the same in every scan.  Rows that no plain scan of files gives are
    written first."""
    frugal(rows.sparkSession)
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        rows = materialize(rows)
    found = rows.metadataColumn("_metadata")
    return rows.select(F.xxhash64(found["file_path"]).alias("_file"), found["row_index"].alias("_row"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_all"))


def same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """A join condition on columns where null equals null."""
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in on))


def sieved(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose columns ``on`` are surely not in
    ``keys``, and those that may be.  Only the latter need a shuffle to find
    out.  ``keys`` should be a written table.  Null equals null."""
    bit = F.pmod(F.xxhash64(*on), F.lit(SIEVE))
    bits = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_bits"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(bits), "_word", "left")
    may = F.expr("coalesce(shiftright(_bits, cast(_bit & 63 as int)) & 1, 0) = 1")
    columns = [f"`{c}`" for c in rows.columns]
    return marked.where(~may).select(columns), marked.where(may).select(columns)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows``, as they were before ``placed``, less those at the places
    ``gone``, a written table."""
    stay, may = sieved(rows, gone, PLACE)
    return stay.union(may.join(gone, PLACE, "left_anti").select(*stay.columns)).select("_all.*")


def purge(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames read from them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
