"""Tab-separated state and gold tables: no quoting, an empty field is an empty text, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lipimala.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows by the header's names; a missing file has none, blank lines are no rows, fields beyond the header
    and columns beyond the row are dropped, and a text column the file lacks is empty.

    Lines are split here and not by the CSV reader, as ``"`` is a glyph like any other. Files are tables that
    people edit and are read whole, so that ``ordinal`` is the file's order.
    """
    kinds = StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(f"{schema}, ordinal bigint"))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "^\ufeff", ""), "\r\n|[\r\n]").alias("all"))
    files = files.withColumn("lines", F.filter("all", lambda x: x != ""))
    first = files.where(F.size("lines") > 0).orderBy("file").select(F.get("lines", F.lit(0))).first()
    names = first[0].split("\t") if first else []
    # a file's first line is its header; the same text further down is data
    body = files.select("file", F.when(F.get("lines", F.lit(0)) == F.lit(first[0] if first else ""), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")).alias("lines"))
    number = F.row_number().over(Window.orderBy("file")) - 1  # one row a file
    cells = body.withColumn("file_no", number).select("file_no", F.posexplode("lines").alias("at", "line")).select(F.split("line", "\t").alias("c"), (F.col("file_no") * (1 << 40) + F.col("at")).cast("bigint").alias("ordinal"))
    columns = []
    for field in kinds:
        if field.name in names:
            cell = F.coalesce(F.get("c", F.lit(names.index(field.name))), F.lit(""))
        else:
            cell = F.lit("")
        text = field.dataType.simpleString() == "string"
        columns.append((cell if text else F.try_to_number(cell, F.lit("S999999999999999999")).cast(field.dataType) if field.dataType.simpleString() in ("int", "bigint") else cell.try_cast(field.dataType)).alias(field.name))
    return cells.select(*columns, "ordinal")


def write_tsv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One file with a header, in order; null is empty, arrays are joined by blanks. For tables people edit."""
    shown = []
    for name in columns:
        kind = rows.schema[name].dataType.simpleString()
        cell = F.array_join(F.array_sort(name), " ") if kind.startswith("array") else F.col(name).cast("string")
        shown.append(F.coalesce(cell, F.lit("")))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    body = rows.select(F.lit(1).alias("_part"), *keys, F.concat_ws("\t", *shown).alias("value"))
    blank = StructType([StructField(f.name, f.dataType) for f in body.schema])
    head = rows.sparkSession.createDataFrame([(0, *[None] * len(order), "\t".join(columns))], blank)
    one = head.unionByName(body).repartition(1).sortWithinPartitions("_part", *(f"_k{i}" for i in range(len(order))))
    one.select("value").write.mode("overwrite").text(path)


def last_wins(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key the one that stands last in the file."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "ordinal").alias("_r")).select(*key, *(F.col(f"_r.{c}") for c in rest))


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(read_tsv(spark, path, schemas.MAPPING), ["glyphs"]).drop("ordinal")


def load_pending(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, schemas.PENDING)
    return rows.withColumn("contexts", F.filter(F.split("contexts", " "), lambda c: c != ""))


def load_names(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.NAMES)


def load_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with names as arrays and their line as ``recipe``."""
    rows = read_tsv(spark, path, schemas.RECIPES)
    return rows.withColumn("names", F.filter(F.split("names", " +"), lambda n: n != "")).withColumnRenamed("ordinal", "recipe")


def load_excluded(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.EXCLUDED).select("shape_id").distinct()


def load_suspicions(spark: SparkSession, path: str) -> DataFrame:
    """Suspicions in the file's order; a page that is no number is null."""
    return read_tsv(spark, path, schemas.SUSPICIONS)


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """Pages already learned from, each once: the first column of a progress file."""
    return read_tsv(spark, path, schemas.PROGRESS).where("page is not null").dropDuplicates(["page"]).drop("ordinal")


def save_unmapped(report: DataFrame, path: str) -> None:
    """A report (glyphs, count) as ``unmapped`` and ``count``, most frequent first."""
    rows = report.select(F.col("glyphs").alias("unmapped"), "count").withColumn("_down", -F.col("count"))
    write_tsv(rows, path, ["unmapped", "count"], ["_down", "unmapped"])


def load_type1_codes(spark: SparkSession, path: str) -> DataFrame:
    """(char, code): the confirmed byte, else the found one, both in hex; rows with neither are left out."""
    rows = read_tsv(spark, path, schemas.TYPE1_LAYOUT)
    byte = F.coalesce(F.nullif("confirmed", F.lit("")), F.nullif("byte", F.lit("")))
    return rows.where(byte.isNotNull()).select("char", F.conv(byte, 16, 10).cast("int").alias("code"))


def load_occurrences(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, schemas.OCCURRENCES)
    box = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))
    return rows.select("page", "line", "word", "position", "shape_id", "band", box.alias("bbox"), F.coalesce("ink", F.lit(0)).alias("ink"))


def save_entries(entries: DataFrame, path: str) -> None:
    write_tsv(entries, path, ["glyphs", "unicode", "first_page", "first_word"], ["glyphs"])


def save_pending(pending: DataFrame, path: str) -> None:
    write_tsv(pending, path, ["glyphs", "unicode", "count", "first_page", "first_word", "contexts"], ["glyphs", "unicode"])


def append_progress(progress: DataFrame, path: str) -> None:
    """Progress is appended as a table: no earlier row is rewritten."""
    progress.write.mode("append").parquet(path)


def checked_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping a user brings along: its header must name glyphs and unicode."""
    head = spark.read.text(path).where("value <> ''").first()
    names = head["value"].lstrip("﻿").split("\t") if head else []
    if not {"glyphs", "unicode"} <= set(names):
        raise ValueError("the mapping's header must have the columns glyphs and unicode")
    return load_entries(spark, path)
