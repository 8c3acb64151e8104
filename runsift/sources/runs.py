"""Run directories as a DataFrame: one row per run with its output, input and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.functions.text import base_name, join_parts, unix_lines

# File names of a run (fixed values); diagnostics are joined in this order.
OUTPUT_NAME = "espresso.pwo"
INPUT_NAME = "espresso.pwi"
INPUT_SUFFIX = ".pwi"
DIAGNOSTIC_NAMES = ("espresso.err", "CRASH")


def plain_path(uri: Column) -> Column:
    """Path text from the scan's file address, which is percent-encoded; a plus sign stays a plus sign."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def file_text(value: str) -> Column:
    """Valid text with one kind of line end."""
    return unix_lines(F.make_valid_utf8(value))


def scan_text(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """Whole text files below the roots (files or folders), with path and modification time."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    scanned = reader.text(list(roots), wholetext=True)
    return scanned.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        file_text("value").alias("text"))


def _is_file(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and system.getFileStatus(path).isFile()


def _empty_paths(spark: SparkSession, roots: Sequence[str], pattern: str, scanned: DataFrame) -> DataFrame:
    """Listed files that the scan passes over, which are those of length zero.

    The listing is the one that Spark makes for the scan, so the driver holds it anyway.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listed = spark.createDataFrame([(p,) for p in reader.text(list(roots), wholetext=True).inputFiles()], "uri string")
    return listed.select(plain_path(F.col("uri")).alias("path")).distinct().join(scanned.select("path"), "path", "left_anti")


def scan_runs(spark: SparkSession, roots: Sequence[str], empty_outputs: DataFrame | None = None) -> DataFrame:
    """All runs of the roots: folders are searched for output files, a file is an output whatever its name.

    Each run comes with its sidecars, which lie beside the output: the input of the same stem, and the diagnostics.
    Empty outputs are failures worth keeping and are found in the file listing; ``empty_outputs`` (path) names more of
    them, for example from a store inventory.
    """
    named = [r for r in roots if _is_file(spark, r)]
    folders = [r for r in roots if r not in named]
    parts = []
    if folders:
        files = scan_text(spark, folders, "{" + ",".join([OUTPUT_NAME, INPUT_NAME, *DIAGNOSTIC_NAMES]) + "}").select("path", "text")
        parts.append(files.withColumn("is_output", base_name(F.col("path")) == OUTPUT_NAME))
        parts.append(_empty_paths(spark, folders, OUTPUT_NAME, files).select("path", F.lit("").alias("text"), F.lit(True).alias("is_output")))
    if named:
        files = scan_text(spark, named, "*").select("path", "text")
        parts.append(files.withColumn("is_output", F.lit(True)))
        parts.append(_empty_paths(spark, named, "*", files).select("path", F.lit("").alias("text"), F.lit(True).alias("is_output")))
        beside = spark.read.option("pathGlobFilter", "{*" + INPUT_SUFFIX + "," + ",".join(DIAGNOSTIC_NAMES) + "}").text(
            sorted({r.rsplit("/", 1)[0] or "/" for r in named}), wholetext=True)
        parts.append(beside.select(plain_path(F.col("_metadata.file_path")).alias("path"), file_text("value").alias("text"),
                                   F.lit(False).alias("is_output")))
    if empty_outputs is not None:
        parts.append(empty_outputs.select("path", F.lit("").alias("text"), F.lit(True).alias("is_output")))
    files = reduce(DataFrame.unionByName, parts)
    return assemble_runs(files.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("run_dir"), base_name(F.col("path")).alias("file_name"), "text", "is_output"))


def assemble_runs(files: DataFrame) -> DataFrame:
    """From (run_dir, file_name, text, is_output) to one row per output file, with the sidecars of its folder.

    Without ``is_output``, files of the usual name are outputs. A file read through two overlapping roots gives one run.
    """
    marked = files if "is_output" in files.columns else files.withColumn("is_output", F.col("file_name") == OUTPUT_NAME)

    def body(name: str) -> Column:
        return F.max(F.when(F.col("file_name") == name, F.col("text")))

    # A folder holds one output, or those that were named one by one.
    named = F.struct("file_name", "text")
    runs = marked.groupBy("run_dir").agg(
        F.collect_set(F.when(F.col("is_output"), named)).alias("outputs"),
        F.collect_set(F.when(F.col("file_name").endswith(INPUT_SUFFIX) & ~F.col("is_output"), named)).alias("inputs"),
        *[body(n).alias(f"d{i}") for i, n in enumerate(DIAGNOSTIC_NAMES)]).withColumn("output", F.explode("outputs"))
    wanted = F.concat(F.regexp_replace(F.col("output.file_name"), r"(?<=.)\.[^.]*$", ""), F.lit(INPUT_SUFFIX))
    found = runs.withColumn("wanted", wanted).withColumn("input_text", F.try_element_at(
        F.transform(F.filter("inputs", lambda x: x["file_name"] == F.col("wanted")), lambda x: x["text"]), F.lit(1)))
    diagnostics = join_parts(*[F.col(f"d{i}") for i in range(len(DIAGNOSTIC_NAMES))])
    return found.select(
        F.concat_ws("/", "run_dir", "output.file_name").alias("output_path"),
        F.when(F.col("input_text").isNotNull(), F.concat_ws("/", "run_dir", "wanted")).alias("input_path"),
        F.nullif("input_text", F.lit("")).alias("input_text"),
        join_parts(F.col("output.text"), diagnostics).alias("output_text"))
