"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str | None] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "enanto", master: str | None = None, shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings win where ``master`` is None."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.config(map=conf or {}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, so that its workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="enanto-ship-")) / "enanto.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def apply_groups(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``applyInPandas`` with this package at hand in the workers; groups are bounded by their callers."""
    ship(df.sparkSession)
    return df.repartition(kernel_partitions(df.sparkSession), *keys).groupBy(*keys).applyInPandas(function, schema)


def kernel_partitions(spark: SparkSession, n_rows: int = 0, most: int = 100_000) -> int:
    """As many partitions as the session sets, more where that would give a task over ``most`` of ``n_rows``: rows that
    are few and small may still be much work in Python, so they aren't put together by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // most))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on a local
    master, as in tests. On a cluster each executor would write to a disk of its own, so that is an error."""
    at = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not at:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor shares")
        app = spark.sparkContext.applicationId
        at = _OWN.setdefault(app, None) or "file://" + tempfile.mkdtemp(prefix="enanto-")
        _OWN[app] = at
    return at.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, which has to be there whatever executors are lost."""
    return f"{scratch_dir(spark)}/enanto-tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, which cuts its lineage.

    The table outlives the executors that wrote it; :func:`drop_scratch` removes all such tables of an application.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows of a few columns at most are sent to all tasks by :func:`with_small`.
SMALL_ROWS = 200_000
SALTS = 64


def with_small(df: DataFrame, small: DataFrame, key: str, named: str, spread: Column) -> DataFrame:
    """``df`` left-joined with a table of one row per key (its column ``named``, dropped), without a task for a hot key.

    The table is written and counted: up to ``SMALL_ROWS`` rows it goes to all tasks. A larger one is repeated under
    ``SALTS`` salts, and rows take the salt that ``spread`` hashes to, so a key's rows meet it in as many tasks.
    """
    small = written(small, "small")
    if small.count() <= SMALL_ROWS:
        return df.join(F.broadcast(small), F.col(key) == F.col(named), "left").drop(named)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = df.withColumn("__mine", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return x.join(salted, (F.col(key) == F.col(named)) & (F.col("__mine") == F.col("__salt")), "left").drop(named, "__salt", "__mine")


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table :func:`written` has left in the shared folder; nothing where no folder is set."""
    try:
        at = tables_dir(spark)
    except ValueError:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
