"""Running aggregates over long ordered streams without one task per stream.

A window partitioned by stream puts a whole stream into one task. Here each
stream is cut into chunks of the order column; the rows are windowed inside
their chunk only, and the aggregate of all earlier chunks is carried in from a
per-chunk summary. The summary is a stream itself, with the chunk as its order, and
is treated in the same way for as many ``levels`` as are asked for: a window then holds
at most ``chunk_width`` rows on each level, however sparse the order is, and on the last
one at most the largest order / chunk_width ** levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WIDTH = 65536
LEVELS = 2  # with the width above, orders up to 2 ** 48 need no window over 65,536 rows


def _chunk_of(order: Column, width: int) -> Column:
    return F.call_function("div", order.cast("bigint"), F.lit(width).cast("bigint"))


def _merge(how: str, carried: Column, local: Column) -> Column:
    if how == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if how == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def running_before(df: DataFrame, keys: list[str], order: str,
                   specs: dict[str, tuple[str, Column]],
                   chunk_width: int = CHUNK_WIDTH, inclusive: bool = False,
                   levels: int = LEVELS) -> DataFrame:
    """Add, per row, aggregates over the rows before it in its stream.

    ``specs`` maps a new column to ``("sum" | "max" | "last", expression)``;
    ``last`` is the latest non-null value. ``order`` is a non-negative whole
    number, unique within a stream. ``inclusive`` also counts the row itself.
    """
    merged_over = {"sum": F.sum, "max": F.max, "last": _last}
    to = 0 if inclusive else -1
    if not levels:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, to)
        return df.select("*", *[merged_over[how](expr).over(whole).alias(name)
                                for name, (how, expr) in specs.items()])
    chunk = f"_chunk{levels}"
    chunked = df.withColumn(chunk, _chunk_of(F.col(order), chunk_width))
    in_chunk = {
        "sum": F.sum, "max": F.max,
        "last": lambda e: F.max_by(e, F.when(e.isNotNull(), F.col(order)))}
    own, before = ({name: f"_{part}{levels}_{name}" for name in specs} for part in "cb")
    per_chunk = chunked.groupBy(*keys, chunk).agg(
        *[in_chunk[how](expr).alias(own[name]) for name, (how, expr) in specs.items()])
    carried = running_before(
        per_chunk, keys, chunk, {before[name]: (how, F.col(own[name])) for name, (how, _) in specs.items()},
        chunk_width, levels=levels - 1).select(*keys, chunk, *before.values())

    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(
        Window.unboundedPreceding, to)
    joined = chunked.join(carried, [*keys, chunk], "left")
    local = joined.select(
        "*", *[merged_over[how](expr).over(inside).alias(f"_l_{name}")
               for name, (how, expr) in specs.items()])
    return local.select(
        *df.columns,
        *[_merge(how, F.col(before[name]), F.col(f"_l_{name}")).alias(name)
          for name, (how, _) in specs.items()])


def with_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], order: str,
                     chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Join one row of facts per group to all rows of the group, also where a group holds a
    large share of the rows.

    A plain join would bring a whole group into one task. The facts are first given to the
    (group, chunk) pairs that occur, which are few, and the rows meet them on both keys.
    Only groups with facts are kept.
    """
    chunked = rows.withColumn("_chunk", _chunk_of(F.col(order), chunk_width))
    pairs = chunked.select(*keys, "_chunk").distinct().join(facts, keys)
    return chunked.join(pairs, [*keys, "_chunk"]).drop("_chunk")
