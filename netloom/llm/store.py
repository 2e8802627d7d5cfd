"""Tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one of our own if all tasks run on this machine.

    With executors elsewhere there is no such folder, as each would write to its own disk: that raises.
    """
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"netloom-{os.getuid()}")
    return folder.rstrip("/")


#: Rows of texts that go to a Python worker at once at most.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch: the default of 10,000 whole texts is tens of megabytes in each of two processes."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Shuffle partitions, which are sized for whole texts, that go into one file of a narrow table: files are few, as each costs
#: its executor several processes where the shared folder is a plain file system.
NARROW = 16


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: a lost executor costs no recomputation.

    ``narrow``: its rows are a few numbers each, a hundredth of a text. They are dealt anew into fewer files by a shuffle of their
    own, so that what computes them keeps all its tasks.
    """
    spark = df.sparkSession
    small_batches(spark)
    if narrow:
        df = df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    path = f"{shared_folder(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.netloom_path = path
    made.append(path)
    return out


#: Tables written by this process that were not deleted, in order.
made: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that were written inside it, but those that were put on the list it gives."""
    start, keep = len(made), []
    yield keep
    kept = {x.netloom_path for x in keep}
    for path in [x for x in made[start:] if x not in kept]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in made:
        made.remove(path)


def renamed(table: DataFrame, *names: str) -> DataFrame:
    """A written table under other column names."""
    out = table.toDF(*names)
    out.netloom_path = table.netloom_path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was derived from them is written itself."""
    for table in tables:
        _delete(table.sparkSession, table.netloom_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text and ``row``, a struct of all columns of ``docs``, whatever their names."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose (doc_id, text_key) is not in ``gone``."""
    return packed(docs).alias("d").join(gone.select("doc_id", "text_key").alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.text_key = g.text_key"), "left_anti").select("row.*")


#: Places in texts that are brought to their texts by a broadcast at most; more are brought by a shuffle of the texts.
BROADCAST_ROWS = 200_000


def beside(texts: DataFrame, places: DataFrame, lists: str, how: str = "inner") -> DataFrame:
    """``texts`` (doc_id, text_key, ...) joined with ``places`` (doc_id, text_key, one array column ``lists``), a written table."""
    total = places.agg(F.sum(F.size(lists))).first()[0] or 0
    some = F.broadcast(places.alias("p")) if total <= BROADCAST_ROWS else places.alias("p").hint("shuffle_hash")
    return texts.alias("d").join(some, F.expr("d.doc_id <=> p.doc_id AND d.text_key = p.text_key"), how).select("d.*", f"p.{lists}")
