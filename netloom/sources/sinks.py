"""Writers of reports and trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a binary trajectory record, without padding.
STEP = np.dtype([("agent_id", "<i8"), ("k", "<i4"), ("link_id", "<i4"), ("arrival_s", "<f4"), ("departure_s", "<f4")])


def write(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None) -> None:
    """A report as Parquet, or as CSV with a header; arrays and maps become ``;``-separated text in CSV."""
    if kind == "csv":
        flat = {f.name: F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";") for f in df.schema if f.dataType.typeName() == "array"}
        flat |= {f.name: F.array_join(F.transform(F.map_entries(f.name), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";") for f in df.schema if f.dataType.typeName() == "map"}
        df = df.withColumns(flat)
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition) if partition else writer).format(kind).save(path)


def pack_steps(events: DataFrame) -> DataFrame:
    """Rows of ``part`` (bytes): link events of a simulation as binary records; a departure that never was is NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, STEP)
            for i, name in enumerate(STEP.names):
                column = batch.column(i)
                rows[name] = column.to_numpy(zero_copy_only=False) if not column.null_count else np.array([np.nan if x is None else x for x in column.to_pylist()])
            yield pa.record_batch([pa.array([rows.tobytes()], pa.binary())], names=["part"])

    return events.select(*STEP.names).mapInArrow(run, "part binary")
