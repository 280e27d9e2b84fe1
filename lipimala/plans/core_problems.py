"""Queries of the general data-preparation operators, with their SQL."""

from __future__ import annotations

from lipimala.operators.dense_counts import atlas_counts, wrong_counts
from lipimala.runtime import table


def p2_found(spark, sf_dir):
    return wrong_counts(table(spark, sf_dir, "atlas_rows"), table(spark, sf_dir, "occurrences"))


def p2_counts(spark, sf_dir):
    return atlas_counts(table(spark, sf_dir, "atlas_rows"), table(spark, sf_dir, "occurrences"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}

_TRUE = """SELECT book, shape_id, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT DISTINCT book, page, line, word, position, shape_id FROM occurrences WHERE shape_id IS NOT NULL) GROUP BY 1, 2"""

ORACLE = {
    "p2_found": f"""SELECT DISTINCT a.book, a.shape_id FROM atlas_rows a LEFT JOIN ({_TRUE}) t
  ON a.book = t.book AND a.shape_id = t.shape_id WHERE a."count" IS NULL OR a."count" <> coalesce(t.n, 0)""",
    "p2_counts": f"""SELECT DISTINCT a.book, a.shape_id, a."count", coalesce(t.n, 0) AS occurrences FROM atlas_rows a
  LEFT JOIN ({_TRUE}) t ON a.book = t.book AND a.shape_id = t.shape_id""",
}
