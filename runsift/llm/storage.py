"""Written tables in the shared folder, and small helpers on column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from runsift.session import ensure_checkpoint_dir


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of 8 MB at most, so that long texts do not add up; a smaller setting stays.

    The setting is one of the session and holds for the plans run after it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def store(df: DataFrame) -> DataFrame:
    """Write the rows to the folder of ``spark.checkpoint.dir`` and read them back.

    The copy cuts the lineage: a lost executor costs a second read, not a second computation. It takes part in
    joins as a plain scan, so adaptive execution can split a hot key on either side.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns whose names clash with ``names``, in either case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
