"""Session defaults and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
}


def get_session(app: str = "ontoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; conf wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=DEFAULTS | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder in spark.checkpoint.dir; a temporary one where none is set, in local mode only, since no other machine sees it."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ontoloom-ckpt-")
    sc.setCheckpointDir(d)
    return d


_homes: set[str] = set()


def app_folder(spark: SparkSession) -> str:
    """The application's own folder below the checkpoint folder; the file system deletes it when the application ends."""
    home = f"{ensure_checkpoint_dir(spark)}/ontoloom-{spark.sparkContext.applicationId}"
    if home not in _homes:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _homes.add(home)
    return home


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read again: its lineage is cut, and a lost executor costs no recomputation.

    A table is written rather than a checkpoint made because a checkpoint carries the plan's size estimate on, which a
    join multiplies: over the rounds of a doubling loop the estimate's digits double each time and planning stops."""
    spark = df.sparkSession
    path = f"{app_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """cut(df) and how many of its rows meet the condition, observed while they are written."""
    seen = Observation()
    made = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return made, seen.get["n"]


_kept: dict[tuple, DataFrame] = {}


def once(name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(source) as a table that is made once per application and state of the source's files, and read from then on."""
    spark = source.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    state = []
    for f in sorted(source.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(conf).getFileStatus(path)
        state.append((f, s.getModificationTime(), s.getLen()))
    key = (spark.sparkContext.applicationId, name, tuple(state))
    if not state:
        return cut(build(source))
    if key not in _kept:
        _kept[key] = cut(build(source))
    return _kept[key]


def discard(*dfs: DataFrame | None) -> None:
    """Deletes the tables of cut() that only earlier rounds of a loop read."""
    for df in dfs:
        for f in df.inputFiles()[:1] if df is not None else []:
            folder = f.rpartition("/")[0]
            if folder.rpartition("/")[2].startswith("cut-"):
                jvm = df.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run and whatever their path: once per application, as a zip that Spark serves to its executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ontoloom-zip-")  # on the driver, which serves it as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{home.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
