"""Session-level helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or a folder of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (``local``) is a temporary
    folder made and set; it goes when the process ends.  On a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="skeinworks-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    atexit.register(_remove, spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: its owner cleans the checkpoint folder
        pass


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """For a table in fewer pieces than there are cores: deal its rows out to all of them.

    Meant for scans before costly work per row; a table in enough pieces is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def free_name(taken, wanted: str) -> str:
    """``wanted``, or ``wanted_1``, ... : the first that no column (case-insensitively) has."""
    low, name, n = {c.lower() for c in taken}, wanted, 0
    while name.lower() in low:
        n += 1
        name = f"{wanted}_{n}"
    return name


def only(df: DataFrame, *wanted: str) -> DataFrame:
    """``df`` such that the wanted names are unambiguous, whatever its other columns are called.

    Where names clash (equal but for case, or altogether) the wanted columns are taken
    by position, the one of exactly that spelling and the first of equal ones, and the
    others are left out.
    """
    low = [c.lower() for c in df.columns]
    if len(set(low)) == len(low):
        return df
    at = {w: df.columns.index(w) if w in df.columns else low.index(w.lower()) if w.lower() in low else None for w in wanted}
    missing = [w for w, i in at.items() if i is None]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    plain = df.toDF(*[f"c{i}" for i in range(len(low))])
    return plain.select(*[F.col(f"c{i}").alias(w) for w, i in at.items()])


def is_plain_scan(df: DataFrame) -> bool:
    """True when ``df`` is all rows of its files, so that what the files say holds for it."""
    return df._jdf.queryExecution().analyzed().nodeName().startswith(("LogicalRelation", "Relation"))


def quoted(name: str):
    """The column of exactly this name, whatever dots or brackets it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
