"""Session helpers: a tuned local session for tests/bench, and the shared
work folder used for written tables and checkpoints."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quire") -> SparkSession:
    """Session for tests and the bench. On a cluster use the cluster's own
    session; every operator only needs a ``SparkSession``."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 << 20))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_root(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in the Python workers (pandas UDFs,
    ``mapInPandas`` and ``applyInPandas`` functions live in it).

    The package is zipped into the shared work folder and added with
    ``addPyFile``, once per application. On a cluster whose work folder is
    not a local path, ship the package with ``--py-files`` instead.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = work_root(spark)
    local = root[len("file:"):] if root.startswith("file:") else root if root.startswith("/") else None
    if local is None:
        _SHIPPED.add(app)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:12]
    os.makedirs(local, exist_ok=True)
    target = os.path.join(local, f"quire-code-{digest}.zip")
    if not os.path.exists(target):
        tmp = target + f".{uuid.uuid4().hex[:6]}.part"
        with zipfile.ZipFile(tmp, "w") as z:
            for f in files:
                z.write(f, os.path.relpath(f, os.path.dirname(pkg)))
        os.replace(tmp, target)
    sc.addPyFile(target)
    _SHIPPED.add(app)


def work_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (the cluster names it); only when it is
    unset (tests, local runs) is a scratch folder created and registered.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="quire-ckpt-")
        sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never-reused path under the work root. Writes go to fresh
    paths so a retried or re-run job never reads what it is overwriting."""
    return f"{work_root(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: the plan runs once, the lineage is cut, and a lost
    executor re-reads files instead of recomputing (never a local
    checkpoint). ``Dataset.checkpoint`` would run an uncached plan twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads. Only folders
    made by ``fresh_path`` are accepted."""
    if not path.startswith(f"{work_root(spark)}/quire/"):
        raise ValueError("not an intermediate table of this session: " + path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
