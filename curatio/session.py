"""Spark session and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "curatio",
                shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster the caller's session (and its spark-defaults) wins: this
    only fills in what is unset.  Locally it sizes shuffles to the cores.
    """
    master = master or os.environ.get("CURATIO_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("CURATIO_DRIVER_MEM", "16g")))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the
    context).  Only a local-mode session without one gets a private
    folder; a cluster session without one is a configuration error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) "
                               "before running iterative operators")
        conf = tempfile.mkdtemp(prefix="curatio-ckpt-", dir=os.environ.get("CURATIO_TMP", "/tmp"))
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    The plan is persisted first: writing a checkpoint otherwise runs the
    whole plan a second time.  The persisted copy is released once the
    checkpoint files exist; later reads come from the shared folder, so an
    executor loss re-reads files instead of replaying the lineage."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist(blocking=False)
    return out


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back:
    cuts the lineage, and later reads prune columns and push filters down."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``curatio`` importable in the Python workers of this session.

    Kernels (pandas UDFs, ``applyInPandas``, ``mapInPandas``) are pickled by
    reference to this package, so every worker must import it.  The package
    is zipped once per SparkContext and added with ``addPyFile`` (shipped to
    every executor on a cluster).  A no-op if it already was."""
    import zipfile

    sc = spark.sparkContext
    key = (id(sc), sc.applicationId)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="curatio-pkg-", dir=os.environ.get("CURATIO_TMP", "/tmp")),
                       "curatio.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
