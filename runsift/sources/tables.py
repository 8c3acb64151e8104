"""CSV readers: every column arrives as text and is cast where it is used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.functions.numeric import blank_to_null, is_true, to_double
from runsift.schemas import RUN_RECORD
from runsift.sources.sinks import fixed_columns


def text_columns(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Named columns of CSV files with a header, all as text; a column the files lack is null."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    return fixed_columns(reader.csv(paths if isinstance(paths, str) else list(paths)), columns)


def typed_records(rows: DataFrame) -> DataFrame:
    """Run records from text columns, with blank as null and bad map text as an empty map."""
    out = []
    for field in RUN_RECORD.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            value = is_true(c)
        elif isinstance(field.dataType, T.DoubleType):
            value = to_double(c)
        elif isinstance(field.dataType, T.IntegerType):
            value = blank_to_null(c).try_cast("int")
        elif isinstance(field.dataType, T.MapType):
            value = species_map(c)
        else:
            value = blank_to_null(c)
        out.append(value.alias(field.name))
    return rows.select(*out)


def species_map(text):
    """JSON object text to a map; malformed text gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def grid_rows(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Grid rows of both layouts: old files have no status and another name for the energy."""
    both = current.unionByName(legacy, allowMissingColumns=True)
    for name in ("energy", "energy_eV_per_atom", "status"):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast("string"))
    energy = F.coalesce(blank_to_null(F.col("energy").cast("string")),
                        blank_to_null(F.col("energy_eV_per_atom").cast("string")))
    return both.withColumns({
        "energy": energy.try_cast("double"),
        "status": F.coalesce(F.col("status"), F.lit("ok")),
    }).drop("energy_eV_per_atom")
