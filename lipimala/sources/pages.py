"""Page content as tables: raw characters, fonts, OCR words, verified text, shape catalogs, books."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipimala.functions.glyphs import ByteCodec, baseline_box, font_family, relayout, symbol_decode
from lipimala.sources import schemas


def raw_characters(pages: DataFrame) -> DataFrame:
    """One row per character of nested pages, with its place in block, line, span; blocks without lines go."""
    block = pages.select("page", F.posexplode("blocks").alias("block_no", "b"))
    line = block.select("page", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    span = line.select("page", "block_no", "line_no", F.col("l.bbox").alias("line_box"), F.posexplode("l.spans").alias("span_no", "s"))
    return span.select("page", "block_no", "line_no", "line_box", "span_no", F.col("s.font").alias("font"), F.col("s.size").alias("size"), F.get("s.origin", F.lit(1)).alias("baseline"), F.posexplode("s.chars").alias("char_no", "c")).select(
        "page", "block_no", "line_no", "line_box", "span_no", "font", "size", "baseline", "char_no", F.col("c.c").alias("char"), F.col("c.bbox").alias("box"), F.get("c.origin", F.lit(0)).alias("origin_x"), F.get("c.origin", F.lit(1)).alias("origin_y")
    )


def page_fonts(pages: DataFrame) -> DataFrame:
    """(page, xref, kind, family) of every font a page names."""
    return pages.select("page", F.explode("fonts").alias("f")).select("page", "f.xref", "f.kind", font_family(F.col("f.name")).alias("family"))


def font_usage(fonts: DataFrame) -> DataFrame:
    """(family, entries, xref): entries over all pages and the first page's reference, most used first."""
    return fonts.groupBy("family").agg(F.count("*").alias("entries"), F.min_by("xref", F.struct("page", "xref")).alias("xref")).orderBy(F.desc("entries"), "family")


def without_type3(chars: DataFrame, fonts: DataFrame) -> DataFrame:
    """Characters of families that a page doesn't hold as Type 3; a line of such spans only vanishes."""
    undecodable = fonts.where("kind = 'Type3'").select("page", "family").distinct()
    return chars.withColumn("family", font_family(F.col("font"))).join(undecodable, ["page", "family"], "left_anti")


def codec_of(profile: dict) -> ByteCodec:
    """The codec that a profile names; Latin-1 without one."""
    return ByteCodec(profile.get("byte_encoding") or "latin-1", {int(b, 16): c for b, c in (profile.get("byte_overrides") or {}).items()})


def decoded(chars: DataFrame, fonts: DataFrame, profile: dict) -> DataFrame:
    """Characters as glyphs: char, box, is_legacy, width. ``profile``: fonts, ascent, descent, byte_encoding and
    byte_overrides (hexadecimal byte to character), or byte_chars made of them, and where the font needs it
    type1_layout (character to character) and plain_pages. Legacy characters are canonical by the codec."""
    codec = codec_of(profile)
    legacy = F.col("family").isin(*profile["fonts"])
    type1 = fonts.where("kind = 'Type1'").select("page", "family").distinct().withColumn("type1", F.lit(True))
    rows = chars.join(type1, ["page", "family"], "left")
    laid = relayout(F.col("char"), F.coalesce("type1", F.lit(False)) & ~F.col("page").isin(*profile.get("plain_pages", [-1])), profile.get("type1_layout", {}))
    char = F.when(legacy, codec.canonical(symbol_decode(laid, profile.get("byte_chars") or codec.table()))).otherwise(symbol_decode(F.col("char")))
    box = F.when(legacy, baseline_box(F.col("box"), F.col("origin_y"), F.col("size"), profile["ascent"], profile["descent"])).otherwise(F.col("box"))
    return rows.withColumn("char", char).withColumn("box", box).withColumn("is_legacy", legacy).withColumn("width", F.col("box.x1") - F.col("box.x0")).drop("type1")


def ocr_words(words: DataFrame, scale: float) -> DataFrame:
    """Readings as an engine gives them: blank ones dropped, trimmed, pixels as points."""
    text = F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    box = F.struct(*((F.col(f"bbox.{c}") / scale).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return words.withColumn("text", text).where("text <> ''").withColumn("bbox", box)


def missing_pages(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Pages whose readings aren't in the cache table yet."""
    return wanted.join(cache.select(*key).distinct(), key, "left_anti")


def read_ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """Files ``page-NNN.json``, each a list of words, as (page, ocr_no, text, confidence, bbox), numbered from 1 a page."""
    files = spark.read.text(f"{path}/page-*.json", wholetext=True)
    page = F.regexp_extract(F.col("_metadata.file_path"), r"page-0*(\d+)\.json", 1).cast("int").alias("page")
    each = files.select(page, F.posexplode(F.from_json("value", "array<struct<text:string,confidence:double,bbox:array<double>>>")).alias("at", "w"))
    box = F.struct(*(F.get("w.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))
    return each.select("page", (F.col("at") + 1).cast("bigint").alias("ocr_no"), "w.text", "w.confidence", box.alias("bbox"))


def verified_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of proofread files ``page-N.unicode.txt``."""
    rows = spark.read.option("wholetext", True).text(f"{path}/page-*.unicode.txt")
    return rows.select(F.regexp_extract(F.input_file_name(), r"page-0*(\d+)\.unicode\.txt", 1).cast("int").alias("page"), F.col("value").alias("text"))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of page files, for an extractor that the deployment brings."""
    return spark.read.format("binaryFile").load(path)


def save_catalog(shapes: DataFrame, path: str) -> None:
    shapes.write.mode("overwrite").parquet(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A saved catalog is frozen: its shapes only count from 0."""
    return spark.read.parquet(path).withColumn("frozen", F.lit(True)).withColumn("count", F.lit(0).cast("bigint"))


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, on any file system the session knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(s.getPath().toString() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or [])


def books(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` that have an ``input`` folder."""
    return [path.rsplit("/", 2)[-2] for path in _listed(spark, f"{root}/*/input")]


def input_file(spark: SparkSession, book: str) -> str:
    """A book's one input PDF; none or several is an error."""
    found = _listed(spark, f"{book}/input/*.pdf")
    if len(found) != 1:
        raise ValueError(f"{book} has {len(found)} input files, not one")
    return found[0]


def load_profile(path: str | None, default: dict) -> dict:
    """A font profile from JSON over the default's values."""
    if path is None or not Path(path).exists():
        return dict(default)
    return {**default, **json.loads(Path(path).read_text(encoding="utf-8"))}


def save_profile(profile: dict, path: str) -> None:
    """Sorted; empty optional fields are left out."""
    kept = {k: v for k, v in sorted(profile.items()) if v not in (None, {}, [])}
    Path(path).write_text(json.dumps(kept, ensure_ascii=False, indent=1) + "\n", encoding="utf-8", newline="\n")


def requested(pages: DataFrame, text: str | None, page: str = "page") -> DataFrame:
    """Pages of a range ``6-10`` or ``6``, both ends included; all without one. Reaches the scan as a filter."""
    if text is None:
        return pages
    first, _, last = text.partition("-")
    return pages.where(F.col(page).between(int(first), int(last or first)))


SCHEMA = schemas.RAW_PAGES
