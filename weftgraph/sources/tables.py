"""Access to input tables and to intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table of a data folder; works with any Hadoop-readable path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`); a private one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    found = f"file://{tempfile.mkdtemp(prefix='weft-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone; the folder is temporary anyway
            return


atexit.register(_clean)


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write `df` once as parquet in the shared folder and return a scan of it.

    This cuts the lineage: a lost executor re-reads files instead of recomputing, and
    both consumers of a shared intermediate read it instead of running it twice. The write's own
    shuffle files go once it is done, as nothing can need them any more. `options` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    try:
        spark.conf.set(CLEAN_SHUFFLES, "true")
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt over all cores: a small file of many rows is one task otherwise, however dear a row is."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def by_text(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """`df` with _text, a digest of the content of these columns, and the distinct contents: _text and the columns. What depends on
    them alone is computed once per content and joined back to all rows that have it."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    keyed = df.withColumn("_text", digest)
    return keyed, keyed.groupBy("_text").agg(*[F.first(c).alias(c) for c in columns])


def extend(grown: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends `rows` to the files of a table that `materialise` returned; what was written before stays as it is. Returns a
    scan of all."""
    path = next(f.rpartition("/")[0] for f in grown.inputFiles())
    rows.select(*grown.columns).write.mode("append").parquet(path)
    return grown.sparkSession.read.schema(grown.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that `materialise` returned, once nothing reads them any more."""
    for df in tables:
        spark, tag = df.sparkSession, "/weft-"
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if tag in path:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
