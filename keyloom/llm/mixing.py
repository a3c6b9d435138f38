"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights (never above `most` times a source's size, the excess
going to the other sources by weight), and every document is taken floor(rate) times plus once more when a number
seeded by its id falls under the fraction of the rate.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; rows with the same doc_id
share their draw; a row without one draws by its text; sources without words have target 0 and rate 0. Only the
per-source sums leave their tasks; they are pre-aggregated, so a source with a third of all rows is not hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, cut, fresh

#: md5's first 13 hexadecimal digits are 52 bits, which a double holds.
BITS = 52
#: Up to so many sources their targets are broadcast; beyond, the join shuffles and Spark splits its hot keys.
BROADCAST_SOURCES = 50_000


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id (of rows without one, on the text) and the seed alone."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    text = F.concat(F.lit(f"{seed}:"), own)
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(2**BITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target. A source is capped when its cap over its weight is at most the water level of
    those that are not; going through the sources in the order of that ratio finds the level at once. The windows
    see one row a source, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("w", w.cast("long")).withColumn("cap", (F.col("source_size") * most).cast("long"))
    # Integer ties and products, not float quotients, decide the order: equal ratios are capped together or not at all.
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = named.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products beyond a long stay exact
    above = wide("cap") * wide("w_left") > wide("left") * wide("w")
    # `left` shared over `w_left` is the level if this source and those after it are not capped.
    level = F.max(F.when(above, F.struct((-F.col("cap") / F.col("w")).alias("o"), F.col("left"), F.col("w_left")))).over(all_rows)
    found = run.withColumn("l", level)
    open_ = F.coalesce(wide("cap") * wide("l.w_left") > wide("l.left") * wide("w"), F.lit(False))
    share = F.col("l.left").cast("double") * F.col("w").cast("double") / F.col("l.w_left").cast("double")
    return found.select("source", "source_size", F.when(open_, share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """row (all columns of the input row), size, source_size, target, copies for every row of `docs`."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sums = fresh(docs, "source", "text").groupBy("source").agg(F.sum(size).alias("source_size"))
    plan = cut(source_targets(sums, weights, most))
    if plan.count() <= BROADCAST_SOURCES:  # a row is a name and three numbers
        plan = F.broadcast(plan)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("of"), F.col("doc_id").alias("id"), size.alias("size"))
    joined = sized.join(plan, sized["of"].eqNullSafe(plan["source"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("id"), F.col("row.text"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document's row as often as it is taken, with the columns of `docs`."""
    mixed = mix(docs, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
