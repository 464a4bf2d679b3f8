"""What the text operators share: table scans, the shared folder and materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-casing of A-Z only, so that results don't depend on a Unicode version.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a master on this machine gets a temporary folder, which goes
    when the process ends; any other master is an error, as its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As ``materialise``, in as many buckets of ``column`` as there are shuffle partitions: joins on it don't move the rows again.

    The table's name goes at once, its files stay in the shared folder.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortBy(column).saveAsTable(own)
    out = spark.table(own)
    out.schema  # resolved, so that the name is no longer needed
    spark.sql(f"DROP TABLE {own}")
    return out


#: Bytes that a broadcast side may hold, as counted by ``fits``.
BROADCAST_BYTES = 32 << 20


def _bytes(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = (lambda x: F.octet_length(x) + 16) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else (lambda x: F.lit(32))
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda acc, x: acc + F.coalesce(inner(x), F.lit(0))), F.lit(0))
    return F.lit(16)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take ``most`` bytes at most, counted over all of them."""
    size = sum((_bytes(df, c) for c in df.columns), F.lit(32).cast("long"))
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it fits; a larger one is joined as Spark sees fit, that is by shuffle."""
    return F.broadcast(df) if fits(df, most) else df


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda a plain column expression is evaluated again for each element."""
    return F.transform(F.array(value), body)[0]
