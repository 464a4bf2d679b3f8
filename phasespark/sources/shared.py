"""Steps that are written to the folder which all executors share, so that plans stay short and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as Parquet in a new folder below that of ``spark.checkpoint.dir``, whose owner empties it.

    Where that is unset, a master on this machine gets a temporary folder that goes with the process; any other master is an error, as its
    executors would each write to a disk of their own.
    """
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="steps-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
