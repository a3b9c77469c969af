"""Session construction and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` wins over them (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is named, a local session gets one of its own; on a cluster, where
    executors would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(shared_dir, "own", None)
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if named is None:
            named = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it reread.

    Cuts the lineage in a way that survives lost executors, and keeps a costly
    stage from being run once for each of its consumers.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


written: list[tuple[str, str]] = []  # application and folder of each table that materialise has written


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has materialised, once no result that reads them is needed; return how many."""
    own = [path for app, path in written if app == spark.sparkContext.applicationId]
    for path in own:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    written[:] = [w for w in written if w[1] not in set(own)]
    return len(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, unless their PYTHONPATH has it."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if here in known or getattr(ship, "app", None) == app:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), f"gleaner-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(here, "gleaner")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, here))
    spark.sparkContext.addPyFile(path)
    ship.app = app
