"""Snapshots: rows as Parquet beside a manifest that is checked before use.

The manifest's checks run in a fixed order and name what is wrong.  Kinds:
``rows``, ``entries`` (all live rows) and ``entries_with_hints`` (also the time
left and the dense rank of recency).
"""

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from poolwright.errors import DuplicateId, SnapshotError, TooManyEntries, WireFormatError
from poolwright.operators.merge import live
from poolwright.schema import Model

# The manifest's marks.
MAGIC, MAJOR, FLAGS = "poolwright", 1, 0
ROWS, ENTRIES, HINTS = "rows", "entries", "entries_with_hints"
KINDS = (ROWS, ENTRIES, HINTS)


def manifest(model: Model, kind: str, count: int) -> dict:
    return {"magic": MAGIC, "major": MAJOR, "kind": kind, "flags": FLAGS, "type_name": model.name, "count": count, "schema": json.loads(model.schema.json())}


def check_manifest(text: str, model: Model, kinds: tuple[str, ...] = KINDS) -> dict:
    """The manifest, or the first of its faults."""
    try:
        m = json.loads(text)
    except ValueError as e:
        raise WireFormatError("truncated", str(e)) from e
    if not isinstance(m, dict) or "magic" not in m:
        raise WireFormatError("version_mismatch", "version 0 has no header")
    if m["magic"] != MAGIC:
        raise WireFormatError("bad_magic", str(m["magic"]))
    if m.get("major") != MAJOR:
        raise WireFormatError("version_mismatch", str(m.get("major")))
    if m.get("kind") not in KINDS:
        raise WireFormatError("unknown_kind", str(m.get("kind")))
    if m["kind"] not in kinds:
        raise WireFormatError("kind_mismatch", m["kind"])
    if m.get("flags") != FLAGS:
        raise WireFormatError("reserved_flags", str(m.get("flags")))
    if m.get("type_name") != model.name:
        raise WireFormatError("type_mismatch", str(m.get("type_name")))
    if m.get("schema") != json.loads(model.schema.json()):
        raise WireFormatError("schema_mismatch")
    return m


def peek_kind(spark: SparkSession, path: str) -> str:
    """The kind that a manifest claims, otherwise unchecked."""
    return json.loads(_manifest_text(spark, path)).get("kind")


def _manifest_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(f"{path}/manifest").collect())


def hints(state: DataFrame, now: datetime) -> DataFrame:
    """Live rows with ``remaining_ms`` (null: no deadline) and ``lru_rank``,
    dense from 0.  Ranks are of the distinct epochs, which are few."""
    alive = state.where(live(now))
    epochs = alive.select("_epoch").distinct().withColumn("lru_rank", F.dense_rank().over(Window.orderBy("_epoch")).cast("long") - 1)
    left = F.when(F.col("_expires_at").isNotNull(), F.floor((F.unix_micros("_expires_at") - F.unix_micros(F.lit(now))) / 1000))
    return alive.join(epochs, "_epoch").withColumn("remaining_ms", left).drop("_epoch", "_expires_at")


def write(state: DataFrame, model: Model, path: str, now: datetime, *, kind: str = ENTRIES) -> None:
    """Live rows, sorted by key, and their manifest, written last."""
    rows = hints(state, now) if kind == HINTS else state.where(live(now)).select(*model.columns())
    rows.orderBy(*model.keys).write.parquet(f"{path}/rows")
    spark = state.sparkSession
    count = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(json.dumps(manifest(model, kind, count)),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def write_rows(rows: DataFrame, model: Model, path: str, *, portable: bool = False) -> None:
    """Rows of a model as they are; ``portable`` demands wire-portable types."""
    if portable and not model.wire_portable:
        raise WireFormatError("not_portable", model.name)
    model.check(rows).write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    count = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(json.dumps(manifest(model, ROWS, count)),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_rows(spark: SparkSession, model: Model, path: str, *, portable: bool = False) -> DataFrame:
    if portable and not model.wire_portable:
        raise WireFormatError("not_portable", model.name)
    check_manifest(_manifest_text(spark, path), model, (ROWS,))
    return spark.read.schema(model.schema).parquet(f"{path}/rows")


def read(spark: SparkSession, model: Model, path: str, now: datetime, *, lru_size: int | None = None, kinds: tuple[str, ...] = (ENTRIES, HINTS)) -> tuple[DataFrame, str]:
    """(residents, kind) of a snapshot after every check."""
    m = check_manifest(_manifest_text(spark, path), model, kinds)
    if lru_size is not None and m["count"] > lru_size:
        raise TooManyEntries(f"{m['count']} rows, the pool holds {lru_size}")
    rows = spark.read.parquet(f"{path}/rows")
    n, distinct = rows.count(), rows.select(*model.keys).distinct().count()
    if n != m["count"]:
        raise SnapshotError(f"{n} rows, the manifest says {m['count']}")
    if distinct != n:
        raise DuplicateId(f"{n - distinct} rows repeat an id")
    if m["kind"] == HINTS:
        at = F.when(F.col("remaining_ms").isNotNull(), F.timestamp_millis(F.lit(int(now.timestamp() * 1000)) + F.col("remaining_ms")))
        return rows.withColumns({"_expires_at": at, "_epoch": F.col("lru_rank")}).select(*model.columns(), "_expires_at", "_epoch"), HINTS
    return rows.select(*model.columns()).withColumns({"_expires_at": F.lit(None).cast("timestamp"), "_epoch": F.lit(0).cast("long")}), ENTRIES
