"""Session set-up and lineage cuts.

Tables that cut lineage are written to the folder named by ``spark.checkpoint.dir`` (shared by all executors).
Only where that setting is absent and driver and executors are one process, as in tests, a folder of our own is used.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def get_spark(app: str = "warploom", **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; settings given by the cluster win."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | _SOUND | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: A union claims the partitioning its parts have in common, but adaptive execution coalesces the parts one by one, so a
#: grouping above it that skips its own shuffle can give a key twice (seen with Spark 4.1). Until that holds, unions claim nothing.
_SOUND = {"spark.sql.unionOutputPartitioning": "false"}


def sound(query: Callable) -> Callable:
    """query(spark, d) with the settings its results depend on."""

    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        for k, v in _SOUND.items():
            spark.conf.set(k, v)
        return query(spark, d)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` of the session, else a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="warploom-")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
    return _OWN[key]


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: a cut that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/warploom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._warploom_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table written by materialize that nothing reads any more."""
    path = getattr(df, "_warploom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """df dealt over all cores if it is small: a small file is one partition, however much is computed on its rows.

    A table of more than ``most`` bytes comes in many partitions and is left as it is.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most max_rows rows, else df as it is.

    The count reads only as many rows as are needed to decide.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(big: DataFrame, small: DataFrame, on: str, how: str = "left", salt_by: str | None = None, salts: int = 8) -> DataFrame:
    """Equi-join of a side whose keys may be very unequal with a smaller side of unique keys.

    Every key of the big side is spread over ``salts`` partitions by a hash of ``salt_by`` (all columns if None) and
    the small side is repeated as often, so no key's rows meet in one task. Null keys match nothing.
    """
    by = [salt_by] if salt_by else [c for c, t in big.dtypes if not t.startswith("map")]
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [on, "_salt"], how).drop("_salt")
