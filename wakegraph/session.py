"""Session defaults, table access and the shared workspace for written intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wakegraph")
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` below `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="wakegraph-")
    return _FALLBACK[app]


def _observed(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Observation]:
    from pyspark.sql import functions as F

    seen = Observation()
    return df.observe(seen, *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen


class Folder:
    """A table that grows by appended pieces and is read by the value of the column it is filed by."""

    def __init__(self, spark: SparkSession, path: str, like: DataFrame, by: str):
        self.spark, self.path, self.by, self.schema = spark, path, by, like.schema
        like.limit(0).write.parquet(f"{path}/{by}=0")

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").partitionBy(self.by).parquet(self.path)

    def append_to(self, value: int, df: DataFrame) -> None:
        """Files rows without the column under one value."""
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{self.by}={value}")

    def append_seen(self, value: int, df: DataFrame, condition: Column) -> bool:
        """append_to, and whether any of the rows met the condition, seen while writing; see Workspace.put_seen."""
        df, got = _observed(df, {"seen": condition})
        self.append_to(value, df)
        return bool(got.get.get("seen"))

    def part(self, value: int) -> DataFrame:
        """What is filed under a value; no rows where nothing is."""
        path = f"{self.path}/{self.by}={value}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        names = [f for f in self.schema.fieldNames() if f != self.by]
        return self.spark.read.schema(self.schema).parquet(path if found else f"{self.path}/{self.by}=0").select(*names)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class Workspace:
    """Tables written below the shared folder, so that lineage ends at files that outlive any executor.

    `put` writes a DataFrame and returns it read back; `drop` deletes one that is no longer needed. What is left stays
    until `release`, as results are read after the operator has returned, or until Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wakegraph-{uuid.uuid4().hex}"
        _OPEN.add(self.root)

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_wakegraph_path"] = path  # the path goes with the DataFrame, not with an id that may be given again
        return out

    def put_seen(self, df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, bool]]:
        """put, and for each condition whether any row met it, seen while writing instead of in a job of its own.

        Only whether a count is zero is used: a task that runs again may be counted twice.
        """
        df, seen = _observed(df, conditions)
        out = self.put(df)
        return out, {n: bool(seen.get.get(n)) for n in conditions}

    def folder(self, like: DataFrame, by: str) -> Folder:
        """An empty table to be filled piece by piece, filed by the column `by`."""
        return Folder(self.spark, f"{self.root}/{uuid.uuid4().hex}", like, by)

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that put gave; others, and tables of other workspaces, stay."""
        path = None if df is None else df.__dict__.get("_wakegraph_path")
        if path and path.startswith(f"{self.root}/"):
            del df.__dict__["_wakegraph_path"]
            _delete(self.spark, path)


_OPEN: set[str] = set()


def release(spark: SparkSession) -> None:
    """Deletes the written intermediates of all operators run so far; DataFrames over them can't be read any more."""
    while _OPEN:
        _delete(spark, _OPEN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    try:
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)
            for root in _FALLBACK.values():
                _delete(spark, root)
    except Exception:  # the JVM may already be gone
        pass
