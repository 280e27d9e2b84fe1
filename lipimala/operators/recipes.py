"""A mapping compiled from named shapes and recipes of names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipimala.functions.telugu import finish_word
from lipimala.operators.transcode import COMPILED

# The sign for a shape that stands for nothing, and the most variants of a recipe.
NOTHING, VARIANTS = "∅", 64


def contribution(unicode: str):
    """A stated text as what it adds: the sign for nothing adds the empty text."""
    return F.when(F.col(unicode) == NOTHING, "").otherwise(F.col(unicode))


def expand(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """(recipe, glyphs, unicode): every recipe (recipe, names array, unicode) over all glyphs of its names.

    The variants of a name are few; the product is built along the recipe by a fold. Recipes that
    ``violations`` reports give no rows.
    """
    variants = names.groupBy("name").agg(F.array_sort(F.collect_list("glyph")).alias("variants"))
    steps = recipes.where(F.size("names") >= 2).select("recipe", "unicode", F.size("names").alias("n"), F.posexplode("names").alias("pos", "name")).join(variants, "name")
    ordered = steps.groupBy("recipe", "unicode", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "variants"))).alias("steps"))
    size = F.aggregate("steps", F.lit(1).cast("bigint"), lambda k, s: k * F.size(s["variants"]))
    whole = ordered.where((F.size("steps") == F.col("n")) & (size <= VARIANTS))
    product = F.aggregate("steps", F.array(F.lit("")), lambda done, s: F.flatten(F.transform(done, lambda d: F.transform(s["variants"], lambda v: F.concat(d, v)))))
    return whole.select("recipe", F.explode(product).alias("glyphs"), contribution("unicode").alias("unicode"))


def entries(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """(glyphs, unicode) of names with a text and of all recipes; a name with an empty text has no entry."""
    single = names.where("unicode <> ''").select(F.col("glyph").alias("glyphs"), contribution("unicode").alias("unicode"))
    return single.unionByName(expand(names, recipes).select("glyphs", "unicode")).distinct()


def violations(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """(kind, what) of everything that forbids compiling: glyphs listed twice, names with several texts,
    recipes of fewer than two names, of unknown names or with too many variants, and keys with two texts."""
    twice = names.groupBy("glyph").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("glyph listed twice").alias("kind"), F.col("glyph").alias("what"))
    several = names.groupBy("name").agg(F.count_distinct(F.coalesce("unicode", F.lit(""))).alias("n")).where("n > 1").select(F.lit("name with several texts").alias("kind"), F.col("name").alias("what"))
    label = F.array_join("names", " ").alias("what")
    short = recipes.where(F.size("names") < 2).select(F.lit("recipe of one name").alias("kind"), label)
    sizes = names.groupBy("name").agg(F.count("*").alias("n"))
    each = recipes.select("recipe", F.array_join("names", " ").alias("what"), F.explode("names").alias("name")).join(sizes, "name", "left")
    unknown = each.where("n is null").select(F.lit("recipe of unknown names").alias("kind"), "what").distinct()
    many = each.groupBy("recipe", "what").agg(F.product(F.col("n").cast("double")).alias("k"), F.count_if(F.col("n").isNull()).alias("u")).where(F.col("k") > VARIANTS).where("u = 0").select(F.lit("recipe of too many variants").alias("kind"), "what")
    clash = entries(names, recipes).groupBy("glyphs").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("key with two texts").alias("kind"), F.col("glyphs").alias("what"))
    out = twice
    for more in (several, short, unknown, many, clash):
        out = out.unionByName(more)
    return out


def _longest_match(text: str, table: dict[str, str], longest: int) -> str:
    out, at = "", 0
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if (value := table.get(text[at : at + n])) is not None:
                out, at = out + value, at + n
                break
        else:
            return "⟦"
    return finish_word(out)


def redundant(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recipes that the other entries make needless: their keys already give the text, and no other key
    reaches across their borders. The compiled entries are one font's, and their number is checked."""
    all_rows = entries(names, recipes).limit(COMPILED + 1).collect()
    if len(all_rows) > COMPILED:
        raise ValueError(f"more than {COMPILED} entries")
    shared = names.sparkSession.sparkContext.broadcast({r["glyphs"]: r["unicode"] for r in all_rows} | {" ": " "})
    grouped = expand(names, recipes).groupBy("recipe").agg(F.array_sort(F.collect_list("glyphs")).alias("keys"), F.first("unicode").alias("unicode"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        beginnings, ends = {}, {}
        for key in table:
            for i in range(1, len(key)):
                beginnings.setdefault(key[:i], set()).add(key)
                ends.setdefault(key[i:], set()).add(key)
        longest = max(map(len, table))
        for batch in batches:
            out = []
            for recipe, keys, unicode in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(keys)
                others = {k: v for k, v in table.items() if k not in own}
                if any(_longest_match(k, others, longest) != finish_word(unicode) for k in keys):
                    continue
                across = any((beginnings.get(k[i:], set()) | ends.get(k[:i], set())) - own for k in keys for i in range(len(k) + 1))
                if not across:
                    out.append(recipe)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(0).type)], names=["recipe"])

    kind = grouped.schema["recipe"].dataType.simpleString()
    return grouped.select("recipe", "keys", "unicode").mapInArrow(check, f"recipe {kind}")


def compile_mapping(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """(glyphs, unicode); raises with the violations and redundant recipes if there are any."""
    problems = [f"{r['kind']}: {r['what']}" for r in violations(names, recipes).limit(20).collect()]
    problems += [f"redundant recipe: {r['recipe']}" for r in redundant(names, recipes).limit(20).collect()] if not problems else []
    if problems:
        raise ValueError("; ".join(problems))
    return entries(names, recipes)
