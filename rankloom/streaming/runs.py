"""Tables that a stream writes batch by batch, in runs that are merged.

Every batch writes a run of its own. After ``merged`` runs of one level they become
one run of the next level, so after n batches a reader meets at most ``merged - 1``
runs on each of log(n) levels, and every row is rewritten once a level. Which runs
hold the first n batches follows from n alone: nothing is listed, a repeated batch
overwrites what it wrote, and no reader sees a run half merged. Runs that a merge has
replaced are removed one batch later, when no repetition can need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MERGED = 8


def run_path(root: str, level: int, number: int) -> str:
    return f"{root}/level={level}/run={number}"


def holding(batches: int, merged: int = MERGED) -> list[tuple[int, int]]:
    """``(level, number)`` of the runs that hold the first so many batches, the
    earliest first."""
    out, level, left = [], 0, batches
    while left:
        left, loose = divmod(left, merged)
        out += [(level, number) for number in range(left * merged + loose - 1, left * merged - 1, -1)]
        level += 1
    return out[::-1]


def due_after(batch: int, merged: int = MERGED) -> list[tuple[int, int]]:
    """The runs to merge once a batch is written, lower levels first."""
    out, level, done = [], 1, batch + 1
    while done % merged**level == 0:
        out.append((level, done // merged**level - 1))
        level += 1
    return out


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written_batches(spark: SparkSession, root: str, merged: int = MERGED) -> int:
    """How many batches the table has: one look at each level's names."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return 0
    done = 0
    for level in fs.listStatus(path):
        size = merged ** int(level.getPath().getName().removeprefix("level="))
        for run in fs.listStatus(level.getPath()):
            whole = _file_system(spark, f"{run.getPath()}/_SUCCESS")[1]
            if fs.exists(whole):
                done = max(done, size * (int(run.getPath().getName().removeprefix("run=")) + 1))
    return done


class Runs:
    """One table below ``root``, with the columns of ``schema`` (DDL), by default in
    folders by the value of ``by``. ``merge`` makes one run's rows of several's."""

    def __init__(
        self, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], by: str | None = None, merged: int = MERGED
    ) -> None:
        self.root, self.schema, self.merge, self.by, self.merged = root, schema, merge, by, merged

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        paths = [run_path(self.root, *run) for run in runs]
        rows = spark.read.schema(self.schema).option("basePath", self.root).parquet(*paths)
        return rows.select(*StructType.fromDDL(self.schema).names)

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows of all earlier batches; a filter on ``by`` reads its folders only."""
        return self._read(spark, holding(batch, self.merged))

    def current(self, spark: SparkSession) -> DataFrame:
        return self.merge(self.before(spark, written_batches(spark, self.root, self.merged)))

    def write(self, rows: DataFrame, batch: int, name: tuple[int, int] | None = None) -> DataFrame:
        """Write a batch's run (again) and read it back."""
        level, number = name or (0, batch)
        if self.by:  # few files per folder, a large one in several
            writer = rows.hint("rebalance", self.by).write.mode("overwrite").partitionBy(self.by)
        else:
            writer = rows.write.mode("overwrite")
        writer.parquet(run_path(self.root, level, number))
        return self._read(rows.sparkSession, [(level, number)])

    def tidy(self, spark: SparkSession, batch: int) -> None:
        """Merge what the batch has made due, and remove what the one before replaced."""
        for level, number in due_after(batch, self.merged):
            parts = [(level - 1, number * self.merged + i) for i in range(self.merged)]
            self.write(self.merge(self._read(spark, parts)), batch, (level, number))
        for level, number in due_after(batch - 1, self.merged) if batch else []:
            for i in range(self.merged):
                fs, path = _file_system(spark, run_path(self.root, level - 1, number * self.merged + i))
                fs.delete(path, True)


def summed(key: str, values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge by adding up."""
    return lambda rows: rows.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


def newest(key: str, version: str) -> Callable[[DataFrame], DataFrame]:
    """Merge by keeping the highest version of each key; versions merge map-side."""
    return lambda rows: rows.groupBy(key).agg(
        F.max_by(F.struct(*rows.columns), F.col(version)).alias("_row")
    ).select("_row.*")
