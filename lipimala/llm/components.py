"""One group identifier for all records linked directly or through others.

Alternating large-star and small-star rewrites of the edge list (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every rewrite is an aggregation and a join, and the edges are unchanged once
every record is linked to its component's smallest identifier and to nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipimala.runtime import cut, hot_join, pick, uncut


def _with_minimum(pairs: DataFrame, entries: int) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its neighbours.

    A hub's rows would meet in one task of a shuffled join, hence the join that knows the hubs.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "u"))
    return hot_join(pairs, least, "u", "degree", entries)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; two numbers reach the driver, whatever the size."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, *, max_rounds: int = 60) -> DataFrame:
    """(group_id, member) of every record in a group of two or more; group_id is the least member.

    Links hold both ways; null ends, self-links and repeated links link nothing more. No link gives no
    rows. Identifiers are bigints. Raises if ``max_rounds`` do not suffice (a path of n records takes
    about log2 n of them).
    """
    one = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    current = cut(one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_minimum(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        spread = _with_minimum(large, before[0])
        star = spread.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(spread.select("u", F.col("m").alias("v")))
        small = cut(star.where("u <> v").distinct(), "small")
        uncut(current)
        uncut(large)
        current, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    members = current.select(F.col("v").alias("group_id"), F.col("u").alias("member"))
    roots = current.select(F.col("v").alias("group_id"), F.col("v").alias("member")).distinct()
    return members.unionByName(roots)


def same_shape_groups(atlas: DataFrame, catalog: DataFrame) -> DataFrame:
    """(group_id, shape_id) from the ``same`` mentions of atlas rows.

    A mention links both ways and across books; ids that are not in the catalog, nulls and self-mentions
    link nothing, and neither do null or empty arrays.
    """
    ids = pick(catalog, "shape_id").select(F.col("shape_id").alias("id")).where("id is not null").distinct()
    links = pick(atlas, "shape_id", "same").select("shape_id", F.explode("same").alias("other")).where("shape_id is not null and other is not null and shape_id <> other").distinct()
    known = links.join(ids, links["shape_id"] == ids["id"], "left_semi").join(ids, F.col("other") == ids["id"], "left_semi")
    groups = connected_components(known, "shape_id", "other")
    return groups.select("group_id", F.col("member").alias("shape_id"))
