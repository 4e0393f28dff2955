"""Text matrices, sensor logs and selections as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value) of a text file, or of the files of a folder in the order of their
    names.

    A line's number is its place in its split, and what comes before that split: one row per split
    is counted and summed, and no line is shuffled.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    places = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(places), ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line_no"), "value")  # a row per split


def read_matrix(spark: SparkSession, data: str, labels: str, split: str = "train") -> DataFrame:
    """(split, row_id, y, features) from a whitespace-separated matrix and a file with a label per
    line, aligned by line number. Files of unequal numbers of lines are an error."""
    n, m = spark.read.text(data).count(), spark.read.text(labels).count()
    if n != m:
        raise ValueError(f"{n} lines of data, {m} labels")
    values = numbered_lines(spark, data).select(F.col("line_no").alias("row_id"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("features"))
    marks = numbered_lines(spark, labels).select(F.col("line_no").alias("row_id"), F.trim("value").cast("double").cast("int").alias("y"))
    return values.join(marks, "row_id").select(F.lit(split).alias("split"), "row_id", "y", "features")


def write_sensor_logs(logs: DataFrame, path: str) -> None:
    """Whitespace-separated logs, ``S<subject>-ADL<number>.dat``, of ``logs(subject, line, values)``;
    a missing value is written as -1. A task writes a file for each subject that it holds."""
    spark, raw = logs.sparkSession, f"{path}-parts"
    value = F.array_join(F.transform("values", lambda x: F.coalesce(x, F.lit(-1.0)).cast("string")), " ").alias("value")
    logs.repartitionByRange("subject", "line").sortWithinPartitions("subject", "line").select("subject", value).write.partitionBy("subject").text(raw)
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(of(path))
    for folder in system.listStatus(of(raw)):
        subject = folder.getPath().getName().removeprefix("subject=")
        names = sorted(f.getPath().toString() for f in system.listStatus(folder.getPath())) if folder.isDirectory() else []
        for number, name in enumerate(n for n in names if "/part-" in n):
            system.rename(of(name), of(f"{path}/S{subject}-ADL{number + 1}.dat"))


def read_sensor_logs(spark: SparkSession, glob: str) -> DataFrame:
    """(file, subject, line_id, values) of whitespace-separated logs. The subject is the digit
    after the first letter of the file's name; line_id grows along a file."""
    name = F.col("_metadata.file_name")
    rows = spark.read.text(glob).select(name.alias("file"), F.monotonically_increasing_id().alias("line_id"), "value").filter("trim(value) <> ''")
    return rows.select("file", F.regexp_extract("file", r"^.(\d)[^-]*-", 1).try_cast("int").alias("subject"), "line_id", F.split(F.trim("value"), r"\s+").cast("array<double>").alias("values"))


def selection_name(dataset: str, mode: str, k: int, technique: str) -> str:
    return f"{dataset}_{mode}_selected_top{k}_{technique}_feature_indices.txt"


def write_selection(selected: DataFrame, path: str) -> None:
    """One feature index per line, in rank order. A selection has at most as many rows as there
    are features, so it is one file."""
    selected.select("rank", F.col("feature").cast("string").alias("value")).coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(rank from 1, feature); blank lines are skipped."""
    kept = numbered_lines(spark, path).filter("trim(value) <> ''").coalesce(1).sortWithinPartitions("line_no")
    return kept.select((F.monotonically_increasing_id() + 1).cast("int").alias("rank"), F.trim("value").cast("int").alias("feature"))


def stacked(*parts: tuple[str, DataFrame]) -> DataFrame:
    """One table of the named parts, each with its name in ``split``."""
    out = None
    for name, rows in parts:
        one = rows.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def write_matrix_text(rows: DataFrame, data: str, labels: str) -> None:
    """Two folders of text files whose names are in row order: a line of values, and a label, for
    each of ``rows(row_id, y, features)``."""
    text = rows.select("row_id", F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("value"), F.col("y").cast("string").alias("label"))
    ranged = text.repartitionByRange("row_id").sortWithinPartitions("row_id")
    ranged.select("value").write.text(data)
    ranged.select(F.col("label").alias("value")).write.text(labels)


def write_cleaned(rows: DataFrame, path: str) -> None:
    """A cleaned matrix with its labels and subjects, as Parquet (row_id, subject, y, features)."""
    rows.select("row_id", "subject", "y", "features").write.parquet(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_client(rows: DataFrame, path: str) -> None:
    """A folder of Parquet per client. Rows are not shuffled, so a large client needs no one task."""
    rows.write.partitionBy("client").parquet(path)
