"""Where pools keep their versions and change logs.

``Held`` keeps both in the driver, for pools of at most a few thousand rows.
``Tables`` keeps them as Parquet in a shared folder: a version is written whole
before the pool points to it, the log grows by a folder for each version, and
neither rows nor events pass through the driver.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from poolwright.errors import ConfigError

ORDER = "_seq"


def counts_of(events: DataFrame) -> dict[str, int]:
    """Events by kind and reason."""
    return {(r["kind"], r["reason"]): r["count"] for r in events.groupBy("kind", "reason").count().collect()}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under the one that ``spark.checkpoint.dir`` names for all
    executors; in local mode one of this machine where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="poolwright-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Held:
    def __init__(self, spark: SparkSession):
        self.spark, self._log = spark, []

    def current(self, schema: T.StructType) -> DataFrame | None:
        """A pool in the driver begins empty."""
        return None

    def save(self, state: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(state.collect(), state.schema)

    def append(self, events: DataFrame, keys: tuple[str, ...]) -> dict:
        rows = events.orderBy("phase", *keys).collect()
        self._log.extend(rows)
        out: dict = {}
        for e in rows:
            out[e["kind"], e["reason"]] = out.get((e["kind"], e["reason"]), 0) + 1
        return out

    def __len__(self) -> int:
        return len(self._log)

    def events(self, first: int, last: int) -> list[Row]:
        return self._log[first:last]


class Tables:
    """Versions under ``root``/state, events under ``root``/events; the last
    ``keep`` versions stay for readers that hold them.  A folder that has
    versions is opened at the last one whose events are there too; what a
    writer that ended early has left beyond it is deleted."""

    def __init__(self, spark: SparkSession, root: str, *, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        states, logs = self._whole("state"), self._whole("events")
        self._version = max(states & logs, default=0)
        for kind in ("state", "events"):
            for v in self._whole(kind, whole=False):
                if v > self._version:
                    self._delete(f"{self.root}/{kind}/v{v:09d}")
        last = self.changelog().agg(F.max(ORDER)).first()[0] if self._version else None
        self._events = 0 if last is None else last + 1

    def _whole(self, kind: str, *, whole: bool = True) -> set[int]:
        """Numbers of the folders that are there, or of those written whole."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return {int(n[1:]) for n in names if n.startswith("v") and (not whole or fs.exists(done(f"{self.root}/{kind}/{n}/_SUCCESS")))}

    def _delete(self, path: str) -> None:
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def current(self, schema: T.StructType) -> DataFrame | None:
        """The last version, if there is one."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/state/v{self._version:09d}") if self._version else None

    def save(self, state: DataFrame) -> DataFrame:
        self._version += 1
        path = f"{self.root}/state/v{self._version:09d}"
        state.write.parquet(path)
        if self._version > self.keep:
            self._delete(f"{self.root}/state/v{self._version - self.keep:09d}")
        return self.spark.read.schema(state.schema).parquet(path)

    def append(self, events: DataFrame, keys: tuple[str, ...]) -> dict:
        ordered = events.orderBy("phase", *keys)
        schema = T.StructType([*ordered.schema.fields, T.StructField(ORDER, T.LongType())])
        start = self._events
        numbered = self.spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + start)), schema)
        path = f"{self.root}/events/v{self._version:09d}"
        numbered.write.parquet(path)
        out = counts_of(self.spark.read.schema(schema).parquet(path))
        self._events += sum(out.values())
        return out

    def __len__(self) -> int:
        return self._events

    def changelog(self) -> DataFrame:
        """All events, numbered from 0 by ``_seq``; also a streaming source."""
        return self.spark.read.parquet(f"{self.root}/events/*")

    def events(self, first: int, last: int) -> list[Row]:
        if first >= last:
            return []
        return self.changelog().where((F.col(ORDER) >= first) & (F.col(ORDER) < last)).orderBy(ORDER).collect()
