"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "rankloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or where that is
    unset a folder beside the tables of the session's warehouse. On a cluster a
    warehouse on the driver's own disk is no such folder, and an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        if not spark.conf.get("spark.master", "local").startswith("local") and folder.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: The tables made so far on the way to one that ``settled`` writes.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Spark's setting: the shuffle files of a query go when it has ended, not when the driver
#: happens to collect its garbage.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, for one written table."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


def written(df, name: str, **options: str):
    """The rows of ``df``, written once and read back: cuts the lineage, and a
    lost executor costs a re-read instead of a recomputation. ``options`` are the
    Parquet writer's."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with freeing(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str, **options: str) -> DataFrame:
    """The rows of ``make()``, ``written``; the tables that it wrote on the way to them are
    removed, so that they must not be used elsewhere."""
    token = _MADE.set(made := [])
    try:
        df = make()
    finally:
        _MADE.reset(token)
    out = written(df, name, **options)
    spark = df.sparkSession
    for path in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    return out


#: Set where tables come as single pieces, such as one file of one row group: the
#: number of tasks they are dealt to. Unset, tables are read as they lie.
INPUT_TASKS = "spark.rankloom.inputTasks"


def dealt(df, always: bool = False):
    """``always``: for rows that grow in their task, such as keys that texts are made
    from; unset, the tasks are then those of an exchange."""
    tasks = df.sparkSession.conf.get(INPUT_TASKS, None)
    if always and not tasks:
        tasks = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(tasks)) if tasks else df
