"""Declared schemas; nothing is ever inferred."""

from __future__ import annotations

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
BOX = "struct<x0:int,y0:int,x1:int,y1:int>"

MAPPING = "glyphs string, unicode string, first_page int, first_word string"
PENDING = "glyphs string, unicode string, count int, first_page int, first_word string, contexts string"
PROGRESS = "page int, glyphs int, unmapped_before int, unmapped_after int, new_entries int"
SUSPICIONS = "glyphs string, suggested string, status string, reason string, page int, word string"
NAMES = "glyph string, name string, unicode string"
RECIPES = "names string, unicode string, note string"
TYPE1_LAYOUT = "char string, codepoint string, byte string, score double, margin double, status string, confirmed string, candidates string"
EXCLUDED = "shape_id bigint"
OCCURRENCES = "page int, line int, word int, position int, shape_id bigint, band string, left int, top int, right int, bottom int, ink int"
DIFFERENCES = "verdict string, count bigint, glyphs string, shapes string, candidate string, reference string, candidate_votes bigint, reference_votes bigint, first_page int"
OCR_WORDS = f"page int, ocr_no bigint, text string, confidence double, bbox {RECT}"
RAW_PAGES = f"page int, fonts array<struct<xref:int,kind:string,name:string>>, blocks array<struct<lines:array<struct<bbox:{RECT},spans:array<struct<font:string,size:double,origin:array<double>,chars:array<struct<c:string,bbox:{RECT},origin:array<double>>>>>>>>>"
RUNS = "book string, source string, source_sha256 string, method string, mapping_sources map<string,string>, pages int, glyphs bigint, coverage double, created string, tool_version string"
