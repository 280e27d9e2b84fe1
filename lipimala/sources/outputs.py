"""Converted text, manifests and reports."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipimala.sources import schemas

# Fixed value: the form of a run's stamp.
STAMP = "%Y%m%dT%H%M%SZ"


def write_pages(pages: DataFrame, path: str) -> None:
    """(book, page, text) partitioned by book, ordered by page within files."""
    pages.repartitionByRange("book", "page").sortWithinPartitions("book", "page").write.mode("overwrite").partitionBy("book").parquet(path)


def book_text(pages: DataFrame, gap: str = "\n\f") -> DataFrame:
    """(book, text): all pages in order. For books, not for collections of them: a text is one value."""
    return pages.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), gap).alias("text"))


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def stamp(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime(STAMP)


def stamp_of(ts):
    """A timestamp column as a run's stamp, in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """A run's lineage as one more row of the table of runs."""
    spark.createDataFrame([run], schemas.RUNS).write.mode("append").parquet(path)


def _place(spark: SparkSession, path: str):
    """(file system, path) of any file system that the session knows; nothing is done on the driver's disk alone."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _child(spark: SparkSession, folder: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)


def archive(spark: SparkSession, path: str, folder: str, moment: str) -> str | None:
    """Moves a final output aside under its stamp before it is written anew; its new path, null if there was none."""
    files, source = _place(spark, path)
    if not files.exists(source):
        return None
    name, dot, ending = source.getName().rpartition(".")
    target = _child(spark, folder, f"{name}-{moment}.{ending}" if dot else f"{ending}-{moment}")
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{path} could not be moved to {target}")
    return target.toString()


def source_changed(spark: SparkSession, path: str, known_sha256: str | None) -> bool:
    """Whether a file is no longer the one of the known digest; hashed where it is read."""
    return known_sha256 is not None and sha256_files(spark, path).first()["sha256"] != known_sha256


def clean(spark: SparkSession, folder: str) -> int:
    """Removes a folder of intermediate files; returns how many went."""
    files, target = _place(spark, folder)
    if not files.exists(target):
        return 0
    count = files.getContentSummary(target).getFileCount()
    files.delete(target, True)
    return int(count)


def approve(spark: SparkSession, batch: str, verified: str, archive_folder: str) -> list[str]:
    """Puts a reviewed batch's pages among the verified ones, numbered with three digits, and the batch into the archive."""
    files, source = _place(spark, batch)
    found = files.globStatus(_child(spark, batch, "page-*.txt")) or []
    pages = {status.getPath().getName(): status.getPath() for status in found}
    util, conf = spark._jvm.org.apache.hadoop.fs.FileUtil, spark._jsc.hadoopConfiguration()
    done = []
    for name in sorted(pages):
        target = _child(spark, verified, f"page-{int(re.search('[0-9]+', name)[0]):03d}.unicode.txt")
        files.mkdirs(target.getParent())
        util.copy(files, pages[name], files, target, False, True, conf)
        done.append(target.getName())
    files.mkdirs(_place(spark, archive_folder)[1])
    files.rename(source, _child(spark, archive_folder, source.getName()))
    return done


def quality_report(spark: SparkSession, quality: DataFrame, confusions: DataFrame, path: str, top: int = 20) -> str:
    """Figures per page as CSV and JSON tables and a summary text: totals and the ``top`` confusions."""
    quality.write.mode("overwrite").option("header", True).csv(f"{path}/pages.csv")
    quality.write.mode("overwrite").json(f"{path}/pages.json")
    total = quality.where("page = 0").orderBy("book").collect()  # one row per book of the report
    rows = confusions.orderBy(F.desc("count"), "ocr", "converted").limit(top).collect()
    lines = ["# Agreement with OCR", "", "| book | words | matched | agreement |", "|---|---|---|---|"]
    lines += [f"| {r['book']} | {r['words']} | {r['matched']} | {r['agreement_rate']:.4f} |" for r in total]
    lines += ["", "| read | meant | times |", "|---|---|---|", *(f"| {r['ocr']} | {r['converted']} | {r['count']} |" for r in rows)]
    return "\n".join(lines) + "\n"
