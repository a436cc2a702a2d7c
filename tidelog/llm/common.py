"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import session
from tidelog.session import discard, ship

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the package goes to the executors with the first one."""
    ship(spark)
    return session.table(spark, sf_dir, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(session.scratch(spark, name))
    return _made[-1]


class Swept:
    """Deletes, at its end, the scratch paths that were made since its start, but for those in `keep`. What still reads them must be done by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.start, self.keep = spark, len(_made), set()

    def __enter__(self) -> Swept:
        return self

    def __exit__(self, *_) -> None:
        mine, _made[self.start :] = _made[self.start :], []
        for path in mine:
            if path not in self.keep:
                discard(self.spark, path)
        _made.extend(p for p in mine if p in self.keep)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks run at once, if it is a plain scan of fewer: one file, or one long row group, is one task otherwise."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(tasks) if "Exchange" not in plan and df.rdd.getNumPartitions() < tasks else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, computes df once and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
