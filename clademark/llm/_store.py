"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is made, but only for a
    local master (tests): executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(made)
    return shared_dir(spark)


#: Paths that the open ``scratch`` blocks have made, the innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later job reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end the tables that ``written`` makes inside the block.

    Gives a function like ``written`` for the tables that stay: what a caller gets must read these alone,
    as the others are gone when its jobs run.
    """
    made: list[str] = []
    _open.append(made)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        stays.append(made[-1])
        return out

    stays: list[str] = []
    try:
        yield kept
    finally:
        _open.pop()
        for path in made:
            if path not in stays:
                _delete(spark, path)
        if _open:
            _open[-1] += stays


#: Keys that a join sends to every task at most.
SENT = 200_000
#: Rows up to which a key is never treated apart.
FEW = 2_000


def joined(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``left`` (a written table) with ``right``, which has a row for each key and in ``weight`` how many rows of ``left`` hold it.

    Keys with more than one in ``SENT`` of these rows are fewer than ``SENT``: they go to every task, and
    their rows stay where they are. All other keys meet by a shuffle, in groups of that bounded size.
    ``how`` is inner, left (for keys that are not null) or left_semi.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(FEW, total // SENT)
    if right.filter(hot).isEmpty():
        return left.join(right, on, how)
    many = F.broadcast(right.filter(hot))
    rest = left.join(F.broadcast(right.filter(hot).select(on)), on, "left_anti")
    return left.join(many, on, "inner" if how == "left" else how).unionByName(rest.join(right.filter(~hot), on, how))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends here: a lost executor costs at most the job that reads the table. The table goes with the ``scratch`` block that it is made in.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame) -> list[Column]:
    """The whole row as one column ``row``, which an operator hands through so that no id has to find it again."""
    return [F.struct(*docs.columns).alias("row")]


def with_row(schema: str, docs: DataFrame) -> StructType:
    """``schema``, and the column ``row`` where ``docs`` has it."""
    return StructType([*StructType.fromDDL(schema), *(f for f in docs.schema if f.name == "row")])
