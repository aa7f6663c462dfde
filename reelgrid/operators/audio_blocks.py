"""Audio as blocks of frames: cutting, resampling, mixing, speech samples.

A block row is a stream's frames ``first`` .. ``first + n - 1`` with one array per channel, or
with null arrays where they are silent, so a gap of any length is one row. Work goes over cells:
ranges of a fixed number of frames, with one frame of overlap where a value needs the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators.running import running_before, with_group_facts

WIDTH = 16384
PIECES = 1024  # cells a chunk of a stream holds where facts or running values go over chunks


def _part(name: str):
    return lambda s: s[name]


def blocks_of_rows(samples: DataFrame, values: list[str], key: str, width: int = WIDTH) -> DataFrame:
    """Blocks of gap-free sample rows (key, frame, values): one for each cell."""
    gathered = samples.groupBy(key, F.expr(f"frame DIV {width}L").alias("cell")).agg(
        F.array_sort(F.collect_list(F.struct("frame", *values))).alias("held"))
    return gathered.select(
        key, F.get("held", 0)["frame"].alias("first"), F.size("held").cast("bigint").alias("n"),
        *[F.transform("held", _part(v)).cast("array<double>").alias(v) for v in values])


def rows_of_blocks(blocks: DataFrame, values: list[str], key: str, width: int = WIDTH) -> DataFrame:
    """Sample rows (key, frame, values) of blocks. A long silence is opened in pieces."""
    is_silent = F.col(values[0]).isNull()
    heard = blocks.where(~is_silent).select(
        key, "first", F.posexplode(F.arrays_zip(*values)).alias("i", "s"))
    pieces = blocks.where(is_silent & (F.col("n") > 0)).select(
        key, (F.col("first") + F.col("n") - 1).alias("last"),
        F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(width))).alias("low"))
    silent = pieces.select(key, F.explode(F.sequence(
        "low", F.least(F.col("low") + (width - 1), F.col("last")))).alias("frame"),
        *[F.lit(0.0).alias(v) for v in values])
    return heard.select(key, (F.col("first") + F.col("i")).alias("frame"),
                        *[F.col("s")[v].alias(v) for v in values]).unionByName(silent)


def timeline_blocks(placed: DataFrame, decoded: DataFrame) -> DataFrame:
    """Blocks (stream_id, first, n, left, right) of a whole timeline: what is kept of each
    decoded block (stream_id, block_seq and arrays left, right), and one row for each gap."""
    at = placed.where("kept_frames > 0").select("stream_id", "block_seq", "skip_frames", "kept_frames",
                                                "out_frame")
    skip, kept = F.col("skip_frames").cast("int") + 1, F.col("kept_frames").cast("int")
    heard = at.join(decoded, ["stream_id", "block_seq"]).select(
        "stream_id", F.col("out_frame").alias("first"), F.col("kept_frames").alias("n"),
        *[F.slice(v, skip, kept).cast("array<double>").alias(v) for v in ("left", "right")])
    gaps = placed.where("gap_frames > 0").select(
        "stream_id", F.col("timeline_end").alias("first"), F.col("gap_frames").alias("n"),
        *[F.lit(None).cast("array<double>").alias(v) for v in ("left", "right")])
    return heard.unionByName(gaps)


def cells(blocks: DataFrame, values: list[str], key: str, width: int = WIDTH,
          overlap: int = 0) -> DataFrame:
    """Blocks cut at multiples of ``width``: one row for each cell with any sound, the silent
    parts of it as zeros, and one row for each run of silent cells.

    With ``overlap`` a cell's arrays also hold the first frame after it, if there is one; ``n``
    does not count it. A silence always leaves its last frame to the cell after it, so the frame
    that follows a silent run is silent too.
    """
    end = F.col("first") + F.col("n")
    low = F.expr(f"greatest(first - {overlap}, 0L) DIV {width}L")
    high = F.expr(f"(first + n - 1) DIV {width}L")
    run, stop = F.expr(f"(first + {width - 1}) DIV {width}L"), F.greatest(
        F.expr(f"(first + {width - 1}) DIV {width}L"), high)
    is_silent = F.col(values[0]).isNull()
    spans = blocks.where("n > 0").select(
        key, "first", "n", *values, end.alias("end"), is_silent.alias("silent"),
        low.alias("low"), high.alias("high"), run.alias("run"), stop.alias("stop"))
    # sound meets every cell of its span, silence the cells beside its run of whole cells, and
    # the run, which is one row however long it is
    def places(low: Column, high: Column, wanted: Column) -> Column:
        none = F.array().cast("array<struct<cell:bigint,run:boolean>>")
        return F.when(wanted & (low <= high), F.transform(F.sequence(low, high), lambda c: F.struct(
            c.alias("cell"), F.lit(False).alias("run")))).otherwise(none)

    silent = F.col("silent")
    met = F.concat(
        places(F.col("low"), F.col("high"), ~silent), places(F.col("low"), F.col("run") - 1, silent),
        places(F.col("stop"), F.col("high"), silent),
        F.when(silent & (F.col("stop") > F.col("run")), F.array(F.struct(
            F.col("run").alias("cell"), F.lit(True).alias("run")))).otherwise(
            F.array().cast("array<struct<cell:bigint,run:boolean>>")))
    at = spans.withColumn("m", F.explode_outer(met)).where("m IS NOT NULL").withColumns({
        "cell": F.col("m.cell"), "is_run": F.col("m.run")}).withColumns({
            "from": F.greatest(F.col("first"), F.col("cell") * width),
            "to": F.when(F.col("is_run"), F.col("stop") * width).otherwise(
                F.least(F.col("end"), (F.col("cell") + 1) * width + overlap))})
    size = F.when(F.col("is_run"), F.lit(0)).otherwise(F.col("to") - F.col("from")).cast("int")
    parts = at.where(F.col("to") > F.col("from")).select(
        key, "cell", "is_run", "from", "to", *[
            F.when(silent, F.array_repeat(F.lit(0.0), size)).otherwise(
                F.slice(v, (F.col("from") - F.col("first") + 1).cast("int"), size)).alias(v) for v in values])
    held = parts.groupBy(key, "cell", "is_run").agg(
        F.array_sort(F.collect_list(F.struct("from", "to", *values))).alias("held"))
    joined = held.select(key, (F.col("cell") * width).alias("first"), "is_run",
                         (F.get("held", 0)["to"] - F.get("held", 0)["from"]).alias("run_frames"), *[
        F.when(~F.col("is_run"), F.flatten(F.transform("held", _part(v)))).alias(v) for v in values])
    frames = F.when(F.col("is_run"), F.col("run_frames")).otherwise(
        F.least(F.size(values[0]).cast("bigint"), F.lit(width).cast("bigint")))
    return joined.select(key, "first", frames.cast("bigint").alias("n"), *values)


def lengths(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.groupBy(key).agg(F.max(F.col("first") + F.col("n")).alias("frames"))


def levels(blocks: DataFrame, key: str, silence: float) -> DataFrame:
    """Per stream: frames, peak, and whether it is only silence."""
    loud = F.greatest(*[F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
                        for v in ("left", "right")])
    return blocks.groupBy(key).agg(
        F.max(F.col("first") + F.col("n")).alias("frames"), F.max(loud).alias("peak"),
        (F.max(loud) <= silence).alias("is_silent"))


def resample(blocks: DataFrame, rates: DataFrame | int, rate_out: int, values: list[str],
             key: str, width: int = WIDTH) -> DataFrame:
    """Linear resampling of gap-free blocks; the last frame repeats.

    A cell makes the output frames that fall between its frames and the next ones, which its one
    frame of overlap allows without a look at the next cell. A silent run stays one row.
    """
    sized = lengths(blocks, key)
    if isinstance(rates, int):
        facts = sized.withColumn("_in", F.lit(rates).cast("bigint"))
    else:
        facts = sized.join(rates.select(key, F.col("sample_rate").cast("bigint").alias("_in")), key)
    facts = facts.where("_in > 0").select(
        key, "_in", F.expr(f"(frames * {rate_out}L + _in DIV 2) DIV _in").alias("_frames"))
    rows = with_group_facts(cells(blocks, values, key, width, overlap=1), facts, [key], "first",
                            width * PIECES)
    # smallest output frame at or after an input frame
    spread = rows.withColumns({
        "_from": F.expr(f"(first * {rate_out}L + _in - 1) DIV _in"),
        "_to": F.expr(f"least(((first + n) * {rate_out}L + _in - 1) DIV _in, _frames)")}
    ).where("_to > _from")
    rate, first = F.col("_in"), F.col("first")
    places = F.transform(F.sequence(F.col("_from"), F.col("_to") - 1), lambda o: tx.let(
        F.call_function("div", o * rate, F.lit(rate_out).cast("bigint")), lambda low: F.struct(
            (low - first).cast("int").alias("i"),
            ((o * rate - low * rate_out) / F.lit(float(rate_out))).alias("part"))))

    def made(v: str) -> Column:
        def at(p: Column) -> Column:
            return tx.let(F.get(v, p["i"]), lambda a: a + (
                F.coalesce(F.get(v, p["i"] + 1), a) - a) * p["part"])
        return F.when(F.col(v).isNotNull(), F.transform("_places", at)).alias(v)

    heard = F.col(values[0]).isNotNull()
    return spread.withColumn("_places", F.when(heard, places)).select(
        key, F.col("_from").alias("first"), (F.col("_to") - F.col("_from")).alias("n"),
        *[made(v) for v in values])


def mix(blocks: DataFrame, gains: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks (recording_id, first, n, left, right): the equal-gain sum of a recording's
    sources, as long as the longest. Frames at which no source has a cell are one silent row.

    ``gains`` has stream_id, recording_id, gain. A cell's task holds one array for each source
    of the recording.
    """
    values = ["left", "right"]
    known = with_group_facts(cells(blocks, values, "stream_id", width), gains, ["stream_id"], "first",
                             width * PIECES)
    sized = (lengths(blocks, "stream_id").join(gains.select("stream_id", "recording_id"), "stream_id")
             .groupBy("recording_id").agg(F.max("frames").alias("frames")))
    heard = known.where("left IS NOT NULL").select(
        "recording_id", "first", "stream_id", *[
            F.transform(v, lambda x: x * F.col("gain")).alias(v) for v in values])
    # by stream, so that a run again adds in the same order
    together = heard.groupBy("recording_id", "first").agg(
        F.array_sort(F.collect_list(F.struct("stream_id", *values))).alias("held"))
    empty = F.array().cast("array<double>")

    def summed(v: str) -> Column:
        return F.aggregate("held", empty, lambda total, s: F.zip_with(
            total, s[v], lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))

    sums = together.select("recording_id", "first", *[summed(v).alias(v) for v in values])
    dense = sums.select("recording_id", "first", F.size("left").cast("bigint").alias("n"), *values)
    return dense.unionByName(_silent_between(dense, sized, values))


def _silent_between(dense: DataFrame, sized: DataFrame, values: list[str]) -> DataFrame:
    """One silent row for each stretch of a recording that no block of ``dense`` covers."""
    spans = dense.select("recording_id", "first", (F.col("first") + F.col("n")).alias("end"))
    # the end of the recording stands as a block of no frames
    ends = sized.select("recording_id", F.col("frames").alias("first"), F.col("frames").alias("end"))
    before = running_before(spans.unionByName(ends), ["recording_id"], "first",
                            {"covered": ("max", F.col("end"))}, WIDTH * PIECES, levels=1)
    start = F.coalesce("covered", F.lit(0))
    return before.where(F.col("first") > start).select(
        "recording_id", start.cast("bigint").alias("first"), (F.col("first") - start).alias("n"),
        *[F.lit(None).cast("array<double>").alias(v) for v in values])


def speech(blocks: DataFrame, rate: int, rate_out: int, sixteen_bit, key: str,
           width: int = WIDTH) -> DataFrame:
    """Blocks (key, first, n, sample) of mono 16-bit samples at ``rate_out``; null where silent."""
    mono = blocks.select(key, "first", "n", F.zip_with("left", "right", lambda a, b: (a + b) / 2).alias("mono"))
    heard = resample(mono, rate, rate_out, ["mono"], key, width)
    return heard.select(key, "first", "n", F.transform("mono", sixteen_bit).alias("sample"))
