"""One group holds most rows: results stay whole, and no task gets the group."""

from pyspark.sql import functions as F

from conftest import rows
from reelgrid.operators import media as md
from reelgrid.operators import search as se
from reelgrid.operators.running import running_before, with_group_facts
from test_search import library


def hot_rows(spark, n=20000):
    """Two thirds of the rows belong to stream 0."""
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"),
                                 F.col("id").alias("o"), (F.col("id") % 97).alias("v"))


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]


def test_running_values_spread_a_hot_stream(spark):
    df = running_before(hot_rows(spark), ["k"], "o", {"s": ("sum", F.col("v"))}, chunk_width=256)
    assert df.count() == 20000
    total = hot_rows(spark).where("k = 0").agg(F.sum("v")).head()[0]
    last = df.where("k = 0").orderBy(F.desc("o")).select(F.col("s") + F.col("v")).head()[0]
    assert last == total
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # A plain window or join would put all 13,334 hot rows into one task.
        spread = running_before(hot_rows(spark), ["k"], "o", {"s": ("sum", F.col("v"))}, 256)
        assert largest_task(spread) < 6000
        facts = hot_rows(spark).groupBy("k").agg(F.max("v").alias("top"))
        joined = with_group_facts(hot_rows(spark), facts, ["k"], "o", 256)
        assert joined.count() == 20000 and largest_task(joined) < 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_stream_frame_report_is_whole(spark):
    frames = hot_rows(spark, 3000).select(
        F.col("k").alias("stream_id"), F.col("o").alias("frame_seq"), F.lit(8).alias("format_code"),
        F.when(F.col("o") == 1500, 2).otherwise(1).alias("width"), F.lit(1).alias("height"),
        F.lit(4).alias("byte_count"))
    hot = md.frame_report(md.check_frames(frames)).where("stream_id = 0").head()
    assert (hot.frames, hot.bad_frames, hot.first_bad_seq, hot.first_reason) == (2000, 1, 1500, "size changed")


def test_term_in_every_segment(spark):
    s, t, r = library(spark, [f"common w{i % 7}" for i in range(300)])
    index = se.build_index(s, t)
    assert rows(index.terms.where("term = 'common'")) == [("common", 300, 300)]
    queries = spark.createDataFrame([(1, "common"), (2, "w3 common")], "query_id int, query string")
    found = se.search_batch(queries, index, s, t, r, limit=100)
    assert rows(found.groupBy("query_id").count(), "query_id") == [(1, 100), (2, 43)]
    assert se.match_query("common", index).count() == 300


def test_running_values_of_a_sparse_order_in_levels(spark):
    """One stream whose order leaves a chunk to each row: no window of the plan is over the
    stream alone but the last, and that one sees few rows."""
    width, n = 16, 4000
    df = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * 1000).alias("o"),
                               (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("w"))
    specs = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "seen": ("last", F.col("w"))}
    got = rows(running_before(df, ["k"], "o", specs, width, levels=5).select("o", "total", "top", "seen"), "o")
    total, top, seen = 0, None, None
    for i, r in enumerate(got):
        assert r == (i * 1000, total, top, seen)
        total, top = total + i % 7, i % 7 if top is None else max(top, i % 7)
        seen = i if i % 5 == 0 else seen
    for level in range(1, 6):  # rows a window of each level holds
        held = df.select(F.expr(f"o DIV {width ** level}").alias("c"), F.expr(f"o DIV {width ** (level - 1)}").alias("r"))
        assert held.distinct().groupBy("c").count().agg(F.max("count")).head()[0] <= width
    assert df.select(F.expr(f"o DIV {width ** 5}")).distinct().count() <= width
