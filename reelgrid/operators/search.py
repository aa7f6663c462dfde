"""Ranked full-text search over transcript segments.

The index is a set of ordinary tables: ``forward`` (one row per segment with its terms and their
positions), ``postings`` (the same, one row per term and segment) and ``blocks`` (for each term,
postings of about equal weight: their number and the best score they can have). Corpus and term
statistics are aggregates over them. Hot terms are no hot spots: a segment's postings are made
inside its row, written range-partitioned by (term bucket, term, block, segment), and filtered
to the query terms before anything else happens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.functions import text as tx

# Ranking constants.
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6

DEFAULT_LIMIT = 50
MAX_LIMIT = 100
SNIPPET_TOKENS = 18
# Folders a stored index is cut into by hash of the term.
SALTS = 16
POSTINGS = ("term string, segment_id string, transcript_id string, start_ms bigint, dl bigint, "
            "tf bigint, positions array<int>, block int, term_bucket int")
FORWARD = ("segment_id string, transcript_id string, recording_id string, start_ms bigint, dl bigint, "
           "held array<struct<term:string,positions:array<int>>>, transcript_bucket int")
BLOCKS = ("term string, block int, n bigint, cf bigint, most_tf bigint, least_ratio double, "
          "term_bucket int")
WORD_ROWS = ("term string, segment_id string, transcript_id string, start_ms bigint, dl bigint, "
             "position int, tf bigint")
TERM_BUCKETS = 64
TRANSCRIPT_BUCKETS = 64
# Blocks a factor of two in segment length per occurrence is cut into.
BLOCK_STEPS = 8
# A search looks at this many postings per wanted hit before it knows what to skip.
FIRST_LOOK = 8
# A rarest word of no more postings is read whole.
FEW_POSTINGS = 1 << 16


# What a posting tells about its segment.
SEGMENT_FACTS = ("segment_id", "transcript_id", "start_ms", "dl")


@dataclass(frozen=True)
class SearchIndex:
    """``postings``: term, segment_id, transcript_id, start_ms, dl, tf, positions, block: all
    that ranking, the status guard, the order and adjacency need, so a query reads the rows of
    its terms and never scans the segments. ``forward``: segment_id, transcript_id,
    recording_id, start_ms, dl, held. ``terms``: term, df, cf. ``blocks``: term, block, n, cf,
    most_tf, least_ratio. ``corpus``: one row with n and avgdl. Postings and blocks have
    term_bucket too when stored; ``buckets`` is the number of term buckets then."""

    postings: DataFrame
    forward: DataFrame
    terms: DataFrame
    blocks: DataFrame
    corpus: DataFrame
    buckets: int | None = None

    @property
    def documents(self) -> DataFrame:
        return self.forward.select("segment_id", "transcript_id", "recording_id", "dl")

    @property
    def positions(self) -> DataFrame:
        return self.postings.select("term", "segment_id", "transcript_id",
                                    F.explode("positions").alias("position"))


def postings_of(forward: DataFrame) -> DataFrame:
    """Postings of forward rows. ``block`` orders a term's postings by what decides their score
    most: the segment's length per occurrence."""
    # an outer explode, since the filter on its input that a plain one implies would repeat the
    # whole making of the words in every step of the plan
    opened = forward.select(*SEGMENT_FACTS, F.explode_outer("held").alias("h")).where("h IS NOT NULL")
    rows = opened.select(F.col("h.term").alias("term"), *SEGMENT_FACTS,
                         F.size("h.positions").cast("bigint").alias("tf"),
                         F.col("h.positions").alias("positions"))
    return rows.withColumn("block", F.floor(F.log2(1 + F.col("dl") / F.col("tf")) * BLOCK_STEPS).cast("int"))


def make_index(forward: DataFrame) -> SearchIndex:
    """Index with all parts derived from its forward rows."""
    postings = postings_of(forward)
    return SearchIndex(postings, forward, term_stats(postings), block_stats(postings),
                       corpus_stats(forward))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def block_stats(postings: DataFrame) -> DataFrame:
    """What bounds the score of each block's postings, whatever the average length is."""
    return postings.groupBy("term", "block").agg(
        F.count("*").alias("n"), F.sum("tf").cast("bigint").alias("cf"), F.max("tf").alias("most_tf"),
        F.min(F.col("dl") / F.col("tf")).alias("least_ratio"))


def corpus_stats(forward: DataFrame) -> DataFrame:
    return forward.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def searchable_segments(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Segments of completed transcripts."""
    completed = transcripts.where(F.col("status") == "completed").select(
        F.col("id").alias("transcript_id"))
    return segments.join(completed, "transcript_id", "left_semi")


def index_segments(segments: DataFrame) -> SearchIndex:
    """Index the given segments (id, transcript_id, recording_id, start_ms, text).

    A segment's words are sorted with their places, and runs of one word become its postings,
    all inside the segment's row: nothing is shuffled.
    """
    tokens = segments.select(
        F.col("id").alias("segment_id"), "transcript_id", "recording_id", "start_ms",
        F.filter(F.transform(tx.index_tokens(F.col("text")), lambda t, i: F.struct(
            t.alias("term"), i.alias("position"))), lambda w: w["term"] != "").alias("words"))
    ordered = tokens.select("*", F.size("words").cast("bigint").alias("dl")).withColumn(
        "words", F.sort_array("words"))

    def opens(i: Column) -> Column:
        return (i == 0) | (F.get("words", i)["term"] != F.get("words", i - 1)["term"])

    every = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(
        F.array().cast("array<int>"))
    cut = ordered.withColumn("starts", F.filter(every, opens))
    # places are read one by one: a slice would copy all words for each term
    held = F.transform("starts", lambda at, k: F.struct(
        F.get("words", at)["term"].alias("term"),
        F.transform(F.sequence(at, F.coalesce(F.get("starts", k + 1), F.size("words")) - 1),
                    lambda i: F.get("words", i)["position"]).alias("positions")))
    return make_index(cut.select("segment_id", "transcript_id", "recording_id", "start_ms", "dl",
                                 held.alias("held")))


def build_index(segments: DataFrame, transcripts: DataFrame) -> SearchIndex:
    """Full index over the segments of completed transcripts."""
    return index_segments(searchable_segments(segments, transcripts))


def write_by_term(postings: DataFrame, path: str, mode: str, buckets: int) -> None:
    """Write postings to folders by term bucket, ordered by term and block."""
    order = ["term_bucket", "term", "block", "segment_id"]
    (postings.withColumn("term_bucket", term_bucket(F.col("term"), buckets))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).partitionBy("term_bucket").parquet(path))


def _batches(spark: SparkSession, path: str) -> list:
    """Finished batches of a stored index from its last full one on, in order; one row for
    each write, so few."""
    try:
        rows = spark.read.schema("batch int, full boolean, drops boolean").parquet(
            f"{path}/batches").orderBy("batch").collect()
    except AnalysisException:  # nothing is stored yet
        return []
    start = max((r.batch for r in rows if r.full), default=0)
    return [r for r in rows if r.batch >= start]


def _write_batch(forward: DataFrame, path: str, buckets: int, full: bool,
                 dropped: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Store forward rows, what follows from them and the transcripts they take rows from as a
    batch of its own. Texts are cut into words once; all else is derived from the stored rows.
    The batch counts once its entry, written last, is there; a write cut short is written over
    by the next. ``gone`` are the forward rows of ``dropped`` transcripts; their statistics are
    taken off."""
    spark = forward.sparkSession
    done = _batches(spark, path)
    number = done[-1].batch + 1 if done else 0

    def folder(name: str) -> str:
        return f"{path}/{name}/batch={number}"

    def stored(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(folder(name))

    own = forward.withColumn("transcript_bucket", term_bucket(F.col("transcript_id"), TRANSCRIPT_BUCKETS))
    # a transcript of very many segments is dealt over SALTS tasks
    (own.repartition("transcript_bucket", F.pmod(F.xxhash64("segment_id"), F.lit(SALTS)))
     .write.mode("overwrite").partitionBy("transcript_bucket").parquet(folder("forward")))
    write_by_term(postings_of(stored("forward", FORWARD)), folder("postings"), "overwrite", buckets)
    blocks = block_stats(stored("postings", POSTINGS))
    (blocks.withColumn("term_bucket", term_bucket(F.col("term"), buckets))
     .repartition("term_bucket", F.pmod(F.xxhash64("term"), F.lit(SALTS * buckets)))
     .sortWithinPartitions("term_bucket", "term", "block")
     .write.mode("overwrite").partitionBy("term_bucket").parquet(folder("blocks")))
    terms = stored("blocks", BLOCKS).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("dl")]
    corpus = stored("forward", FORWARD).agg(*sums)
    if gone is not None:
        terms = terms.unionByName(term_stats(postings_of(gone)).select(
            "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        less = gone.agg(*sums).select((-F.col("n")).alias("n"), (-F.col("dl")).alias("dl"))
        corpus = corpus.unionByName(less)
        dropped.select("transcript_id").distinct().write.mode("overwrite").parquet(folder("dropped"))
    terms.write.mode("overwrite").parquet(folder("terms"))
    corpus.write.mode("overwrite").parquet(folder("corpus"))
    spark.range(1).select(F.lit(full).alias("full"), F.lit(gone is not None).alias("drops")).write.mode(
        "overwrite").parquet(folder("batches"))


def write_index(index: SearchIndex, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Store a whole index; readers leave batches before it aside. Range partitioning on
    (bucket, term, block, segment) splits a term that holds a large share of all postings over
    many files."""
    _write_batch(index.forward, path, buckets, full=True)


def compact_index(spark: SparkSession, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Fold all batches of a stored index into one: rows of replaced transcripts go for good, and
    readers need no list of them any more. No text is read. Searches see the old batches until
    the new one is finished; a run that was cut off can be started again."""
    if len(_batches(spark, path)) > 1:
        _write_batch(read_index(spark, path, buckets).forward, path, buckets, full=True)


def idle_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batches no reader needs any more: their folders may go."""
    live = {r.batch for r in _batches(spark, path)}
    rows = spark.read.schema("batch int, full boolean, drops boolean").parquet(f"{path}/batches").collect()
    return sorted({r.batch for r in rows} - live)


def read_index(spark: SparkSession, path: str, buckets: int = TERM_BUCKETS) -> SearchIndex:
    """The stored index: rows and statistics of its finished batches, without the rows that
    later batches dropped."""
    done = _batches(spark, path)
    numbers = [r.batch for r in done]

    def part(name: str, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{name}").where(
            F.col("batch").isin(numbers))

    tables = [part("postings", POSTINGS), part("forward", FORWARD)]
    if any(r.drops for r in done):
        last = part("dropped", "transcript_id string").groupBy(
            F.col("transcript_id").alias("gone_id")).agg(F.max("batch").alias("gone_batch"))
        tables = [t.join(last, (t["transcript_id"] == last["gone_id"])
                         & (t["batch"] < last["gone_batch"]), "left_anti") for t in tables]
    postings, forward = [t.drop("batch") for t in tables]
    terms = part("terms", "term string, df bigint, cf bigint").drop("batch")
    if len(done) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    corpus = part("corpus", "n bigint, dl bigint").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("dl"), F.sum("n")).alias("avgdl"))
    # blocks of replaced transcripts only make a bound wider
    blocks = part("blocks", BLOCKS).groupBy("term_bucket", "term", "block").agg(
        F.sum("n").alias("n"), F.sum("cf").alias("cf"), F.max("most_tf").alias("most_tf"),
        F.min("least_ratio").alias("least_ratio"))
    return SearchIndex(postings, forward, terms, blocks, corpus, buckets)


def reindex(segments: DataFrame, transcripts: DataFrame, path: str,
            buckets: int = TERM_BUCKETS) -> DataFrame:
    """Rebuild the stored index; returns one row with the number of segments indexed."""
    write_index(build_index(segments, transcripts), path, buckets)
    stored = read_index(segments.sparkSession, path, buckets)
    return stored.corpus.select(F.col("n").alias("indexed_segment_count"))


def unindexed_segments(segments: DataFrame, transcripts: DataFrame,
                       index: SearchIndex) -> DataFrame:
    """Searchable segments the index does not hold yet."""
    known = index.documents.select(F.col("segment_id").alias("id"))
    return searchable_segments(segments, transcripts).join(known, "id", "left_anti")


def extend_index(segments: DataFrame, transcripts: DataFrame, index: SearchIndex) -> SearchIndex:
    """Index plus the segments that were missing from it."""
    added = index_segments(unindexed_segments(segments, transcripts, index))
    return union_index(index, added)


def append_missing(segments: DataFrame, transcripts: DataFrame, path: str,
                   buckets: int = TERM_BUCKETS) -> None:
    """Append the missing segments to a stored index; only they are tokenised. Safe to run
    again after it was cut off."""
    stored = read_index(segments.sparkSession, path, buckets)
    added = index_segments(unindexed_segments(segments, transcripts, stored))
    _write_batch(added.forward, path, buckets, full=False)


def replace_stored(new_segments: DataFrame, new_transcripts: DataFrame, path: str,
                   buckets: int = TERM_BUCKETS) -> None:
    """Bring replaced transcripts of a stored index up to date: their old rows are dropped on
    reading, new ones come in where the new transcript is completed. Only rows of these
    transcripts are written."""
    spark = new_segments.sparkSession
    new = build_index(new_segments, new_transcripts).forward
    if not _batches(spark, path):
        _write_batch(new, path, buckets, full=True)
        return
    ids = new_transcripts.select(F.col("id").alias("transcript_id")).distinct()
    bucket = term_bucket(F.col("transcript_id"), TRANSCRIPT_BUCKETS)
    touched = [r[0] for r in ids.select(bucket).distinct().collect()]  # TRANSCRIPT_BUCKETS at most
    stored = read_index(spark, path, buckets).forward.where(F.col("transcript_bucket").isin(touched))
    gone = stored.drop("transcript_bucket").join(ids, "transcript_id", "left_semi")
    _write_batch(new, path, buckets, full=False, dropped=ids, gone=gone)


def union_index(a: SearchIndex, b: SearchIndex) -> SearchIndex:
    return make_index(a.forward.drop("transcript_bucket").unionByName(b.forward.drop("transcript_bucket")))


def drop_transcripts(index: SearchIndex, transcript_ids: DataFrame) -> SearchIndex:
    """Index without the rows of the given transcripts (one column, transcript_id)."""
    return make_index(index.forward.join(transcript_ids, "transcript_id", "left_anti"))


def replace_in_index(index: SearchIndex, new_segments: DataFrame,
                     new_transcripts: DataFrame) -> SearchIndex:
    """Index after some transcripts were replaced: their old rows go, and the new
    segments come in only where the new transcript is completed."""
    replaced = new_transcripts.select(F.col("id").alias("transcript_id"))
    return union_index(drop_transcripts(index, replaced),
                       build_index(new_segments, new_transcripts))


def drop_orphans(index: SearchIndex, segments: DataFrame) -> SearchIndex:
    """Index without rows whose segment no longer exists."""
    alive = segments.select(F.col("id").alias("segment_id"))
    return make_index(index.forward.join(alive, "segment_id", "left_semi"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """One row per query word: query_id, n_phrases, phrase_no, phrase, n_words, offset, term.

    ``queries`` has query_id and query. A query without tokens yields no row,
    hence no results; a token without any index word can never match.
    """
    phrases = queries.select(
        "query_id", tx.query_phrases(F.col("query")).alias("phrases")
    ).select("query_id", F.size("phrases").alias("n_phrases"),
             F.posexplode("phrases").alias("phrase_no", "words"))
    return phrases.select(
        "query_id", "n_phrases", "phrase_no", F.array_join("words", " ").alias("phrase"),
        F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """Okapi score of one phrase, negated so that lower is better."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    norm = tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl)
    return -idf * tf * (BM25_K1 + 1) / norm


def _rows_of_words(words: DataFrame, rows: DataFrame, buckets: int | None) -> DataFrame:
    """Index rows of the given words (phrase, n_words, offset, term), by bucket and term."""
    wanted = words.select("phrase", "n_words", "offset", "term").distinct()
    if not buckets:
        return wanted.join(rows, "term")
    return wanted.withColumn("term_bucket", term_bucket(F.col("term"), buckets)).join(
        rows, ["term_bucket", "term"])


def single_hits(words: DataFrame, index: SearchIndex | WordIndex) -> DataFrame:
    """phrase, segment facts and tf of the phrases of one word."""
    return _rows_of_words(words.where("n_words = 1"), index.postings, index.buckets).select(
        "phrase", *SEGMENT_FACTS, "tf")


def adjacent_hits(words: DataFrame, index: SearchIndex | WordIndex) -> DataFrame:
    """phrase, segment facts and tf of the phrases of several words, which must follow
    each other: the places where each word lets its phrase start are intersected."""
    rows = _rows_of_words(words.where("n_words > 1"), index.postings, index.buckets)
    met = rows.groupBy("phrase", "n_words", *SEGMENT_FACTS).agg(
        F.count("*").alias("found"),
        F.collect_list(F.transform("positions", lambda p: p - F.col("offset"))).alias("starts")
    ).where("found = n_words")
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", 0), F.array_intersect)
    return met.select("phrase", *SEGMENT_FACTS, F.size(common).cast("bigint").alias("tf")).where("tf > 0")


@dataclass(frozen=True)
class WordIndex:
    """What a batch of queries needs of an index, for its own words alone: ``postings``, ``terms``
    and ``corpus`` as in ``SearchIndex``; positions only of words that stand in longer phrases."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int | None = None


def index_words(queries: DataFrame, segments: DataFrame, path: str) -> WordIndex:
    """Postings of the words of ``queries`` over all ``segments``, stored at ``path``.

    A batch that is asked once needs no other words, so its index is read off the texts in one
    pass. Every segment is counted and measured by the empty word, which is put before its first
    one. A word of a longer phrase has a row for each place, any other a row for each segment.
    """
    spark = segments.sparkSession
    asked = parse_queries(queries).where("term <> ''").groupBy("term").agg(
        F.max(F.col("n_words") > 1).alias("placed"))
    wanted = asked.unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(False).alias("placed")))
    words = segments.select(F.col("id").alias("segment_id"), "transcript_id", "start_ms",
                            tx.index_tokens(F.col("text")).alias("words"))
    sized = words.withColumn("dl", F.size(F.array_remove("words", "")).cast("bigint"))
    # an outer explode, as for postings
    opened = sized.select(
        *SEGMENT_FACTS, F.posexplode_outer(F.concat(F.array(F.lit("")), "words")).alias("place", "term"))
    found = opened.where("place = 0 OR term <> ''").join(wanted, "term")
    (found.groupBy("term", *SEGMENT_FACTS, F.when(F.col("placed"), F.col("place") - 1).alias("position"))
     .agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(path))
    rows = spark.read.schema(WORD_ROWS).parquet(path)
    placed = rows.where("position IS NOT NULL").groupBy("term", *SEGMENT_FACTS).agg(
        F.sum("tf").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    postings = rows.where("term <> '' AND position IS NULL").select(
        "term", *SEGMENT_FACTS, "tf", F.lit(None).cast("array<int>").alias("positions")).unionByName(placed)
    corpus = rows.where("term = ''").agg(
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n"),
        F.try_divide(F.sum(F.col("dl") * F.col("tf")), F.sum("tf")).alias("avgdl"))
    return WordIndex(postings, term_stats(postings), corpus)


def match_and_rank(queries: DataFrame, index: SearchIndex | WordIndex) -> DataFrame:
    """query_id, segment_id, transcript_id, start_ms, rank of every segment holding all
    phrases of its query.

    Only segments with a query's rarest phrase are candidates; its other phrases are
    looked up for those alone, on (phrase, segment).
    """
    words = parse_queries(queries)
    adjacent = adjacent_hits(words, index)
    hits = single_hits(words, index).unionByName(adjacent)
    frequency = words.where("n_words = 1").select("phrase", "term").distinct().join(
        index.terms, "term").select("phrase", "df").unionByName(
        adjacent.groupBy("phrase").agg(F.count("*").alias("df")))
    phrases = words.select("query_id", "n_phrases", "phrase_no", "phrase").distinct().join(
        frequency, "phrase")
    complete = (
        phrases.groupBy("query_id", "n_phrases")
        .agg(F.count("*").alias("found"), F.min_by("phrase", F.struct("df", "phrase_no"))
             .alias("rarest"))
        .where("found = n_phrases").select("query_id", F.col("rarest").alias("phrase")))
    # A phrase of very many segments that is the rarest of many queries is dealt over SALTS.
    salt = F.pmod(F.xxhash64("segment_id"), F.lit(SALTS)).cast("int").alias("salt")
    candidates = complete.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(
        hits.select("phrase", "segment_id", salt), ["phrase", "salt"]).select(
        "query_id", "segment_id")
    scored = (
        candidates.join(phrases, "query_id")
        .join(hits, ["phrase", "segment_id"])
        .select("query_id", "n_phrases", "phrase_no", *SEGMENT_FACTS,
                bm25(F.col("tf"), F.col("dl"), F.col("df"), index.corpus.select("n").scalar(),
                     index.corpus.select("avgdl").scalar()).alias("score")))
    return (
        scored.groupBy("query_id", "n_phrases", "segment_id", "transcript_id", "start_ms")
        .agg(F.array_sort(F.collect_list(F.struct("phrase_no", "score"))).alias("scores"))
        .where(F.size("scores") == F.col("n_phrases"))
        # added in the order of the query, so that equal segments get equal ranks
        .select("query_id", "segment_id", "transcript_id", "start_ms", F.aggregate(
            "scores", F.lit(0.0), lambda total, s: total + s["score"]).alias("rank")))


@dataclass(frozen=True)
class Query:
    """Phrases of one query and the buckets of its words, known when the plan is made."""

    phrases: list[list[str]]
    bucket_of: dict[str, int]

    @property
    def singles(self) -> list[str]:
        return sorted({words[0] for words in self.phrases if len(words) == 1})

    @property
    def longer(self) -> list[tuple]:
        return sorted({tuple(words) for words in self.phrases if len(words) > 1})


def parse_query(spark: SparkSession, query: str, buckets: int | None) -> Query:
    words = F.flatten("p") if buckets else F.array().cast("array<string>")
    row = spark.range(1).select(tx.query_phrases(F.lit(query)).alias("p")).select(
        "p", F.transform(words, lambda w: F.struct(
            w.alias("term"), term_bucket(w, buckets or 1).alias("bucket"))).alias("b")).head()
    phrases = [list(words) for words in row["p"]]
    return Query(phrases if all(phrases) else [], {b["term"]: b["bucket"] for b in row["b"]})


def match_query(query: str, index: SearchIndex) -> DataFrame:
    """segment_id, transcript_id, start_ms, rank of every segment holding all phrases of
    one query.

    The words of the query are known when the plan is made, so the postings scan is
    pruned by bucket and term, and one shuffle by segment brings the words together.
    """
    return _matches(parse_query(index.forward.sparkSession, query, index.buckets), index)


def _matches(query: Query, index: SearchIndex, few: tuple[str, int] | None = None) -> DataFrame:
    """Matches of a query; with ``few`` only those of a word's blocks up to a number."""
    spark = index.forward.sparkSession
    phrases, singles, longer = query.phrases, query.singles, query.longer
    if not phrases:
        return spark.createDataFrame(
            [], "segment_id string, transcript_id string, start_ms bigint, rank double")
    rows = _pruned(index.postings, singles, query.bucket_of)
    if few is not None:
        rows = rows.where((F.col("term") != few[0]) | (F.col("block") <= few[1]))
    hits = rows.select(F.col("term").alias("phrase"), *SEGMENT_FACTS, "tf")
    if longer:
        words = spark.createDataFrame(
            [(" ".join(p), len(p), o, t) for p in longer for o, t in enumerate(p)],
            "phrase string, n_words int, offset int, term string")
        wanted = sorted({t for p in longer for t in p})
        near = replace(index, postings=_pruned(index.postings, wanted, query.bucket_of))
        hits = hits.unionByName(adjacent_hits(words, near))

    names = {p: f"n{i}" for i, p in enumerate([*singles, *(" ".join(p) for p in longer)])}
    counted = hits.groupBy(*SEGMENT_FACTS).agg(
        *[F.max(F.when(F.col("phrase") == p, F.col("tf"))).alias(c) for p, c in names.items()])
    known = index.terms.where(F.col("term").isin(singles)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("m")).scalar()
    n, avgdl = (index.corpus.select(c).scalar() for c in ("n", "avgdl"))
    score, present = F.lit(0.0), F.lit(True)
    for words in phrases:
        column = names[" ".join(words)]
        if len(words) == 1:
            df = F.try_element_at(known, F.lit(words[0]))
        else:
            df = counted.agg(F.count(column).alias("df")).scalar()
        score = score + bm25(F.col(column), F.col("dl"), df, n, avgdl)
        present = present & F.col(column).isNotNull()
    return counted.where(present).select(
        "segment_id", "transcript_id", "start_ms", score.alias("rank"))


@dataclass(frozen=True)
class Skipping:
    """Blocks of a query's rarest word, best first: number, postings in it and before it, and
    the best rank a segment of it can have with the best of all other words added."""

    term: str
    blocks: list[tuple[int, int, float]]

    @property
    def postings(self) -> int:
        return self.blocks[-1][1]

    def first(self, wanted: int) -> int:
        """The block up to which there are so many postings."""
        return next((number for number, held, _ in self.blocks if held >= wanted), self.blocks[-1][0])

    def needed(self, worst: float | None) -> int:
        """The last block that may hold a rank of ``worst`` or better."""
        if worst is None:
            return self.blocks[-1][0]
        slack = abs(worst) * 1e-9
        return max((number for number, _, best in self.blocks if best <= worst + slack),
                   default=self.blocks[0][0])

    def read(self, last: int) -> int:
        return max(held for number, held, _ in self.blocks if number <= last)


def skipping(query: Query, index: SearchIndex, least: int) -> Skipping | None:
    """What a search may skip; None where the rarest word has ``least`` postings or fewer, or
    the query has no word that stands alone. A word has a few hundred blocks at most."""
    singles = query.singles
    if not singles:
        return None
    known = {r.term: r for r in index.terms.where(F.col("term").isin(singles)).select(
        "term", "df", index.corpus.select("n").scalar().alias("n"),
        index.corpus.select("avgdl").scalar().alias("avgdl")).collect()}
    if len(known) < len(singles):
        return None
    term = min(singles, key=lambda t: (known[t].df, t))
    if known[term].df <= least:
        return None
    rows = _pruned(index.blocks, singles, query.bucket_of).select(
        "term", "block", "n", "most_tf", "least_ratio").collect()

    def idf(df: int) -> float:
        n = known[term].n
        return max(math.log((n - df + 0.5) / (df + 0.5)), IDF_FLOOR)

    def best(r) -> float:
        ratio = (1 - BM25_B) / r.most_tf + BM25_B * r.least_ratio / known[r.term].avgdl
        return -idf(known[r.term].df) * (BM25_K1 + 1) / (1 + BM25_K1 * ratio)

    # a phrase of several words is no rarer than one segment, and scores below its limit
    others = -sum(idf(1) * (BM25_K1 + 1) for words in query.phrases if len(words) > 1)
    for words in query.phrases:
        if len(words) == 1 and words[0] != term:
            others += min(best(r) for r in rows if r.term == words[0])
    times = sum(words == [term] for words in query.phrases)
    blocks, held = [], 0
    for r in sorted((r for r in rows if r.term == term), key=lambda r: r.block):
        held += r.n
        blocks.append((r.block, held, times * best(r) + others))
    return Skipping(term, blocks)


def _pruned(rows: DataFrame, terms: list[str], bucket_of: dict[str, int]) -> DataFrame:
    """Index rows of known terms, with filters the scan can use."""
    found = rows.where(F.col("term").isin(terms))
    if not bucket_of or not terms:
        return found
    return found.where(F.col("term_bucket").isin(sorted({bucket_of[t] for t in terms})))


def _live(ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Hits of completed transcripts, with their recording. The index may be stale."""
    completed = transcripts.where(F.col("status") == "completed").select(
        F.col("id").alias("transcript_id"), "recording_id")
    return ranked.join(completed, "transcript_id")


def _dated(hits: DataFrame, recordings: DataFrame) -> DataFrame:
    created = recordings.select(F.col("id").alias("recording_id"), "created_at")
    return hits.join(created, "recording_id")


def _result_order() -> list[Column]:
    return [F.asc("rank"), F.desc("created_at"), F.asc("start_ms"), F.asc("segment_id")]


def _details(top: DataFrame, segments: DataFrame, recordings: DataFrame) -> DataFrame:
    wide = segments.select(F.col("id").alias("segment_id"), "segment_index", "end_ms", "text")
    shown = recordings.select(
        F.col("id").alias("recording_id"), F.col("title").alias("recording_title"),
        "media_path", "thumbnail_path", "captured_at")
    return top.join(wide, "segment_id").join(shown, "recording_id")


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def search_batch(queries: DataFrame, index: SearchIndex | WordIndex, segments: DataFrame,
                 transcripts: DataFrame, recordings: DataFrame,
                 limit: int | None = None) -> DataFrame:
    """Top hits of many queries.

    Queries of the same phrases in the same order are searched once; their hits go to each
    of them after the cut.
    Both windows keep at most k rows (and ties) per query inside each task before the
    shuffle, so a query that matches most segments stays cheap.
    """
    k = clamp_limit(limit)
    asked = queries.select("query_id", F.to_json(tx.query_phrases(F.col("query"))).alias("same"),
                           "query")
    once = asked.groupBy("same").agg(F.min("query").alias("query")).withColumnRenamed(
        "same", "query_id")
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    near = _live(match_and_rank(once, index), transcripts).withColumn(
        "near", F.rank().over(by_rank)).where(F.col("near") <= k).drop("near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_result_order()))
    top = _dated(near, recordings).withColumn("place", place).where(F.col("place") <= k)
    shown = _details(top, segments, recordings).withColumnRenamed("query_id", "same")
    return asked.select("query_id", "same").join(shown, "same").drop("same")


def few_blocks(asked: Query, index: SearchIndex, transcripts: DataFrame, k: int,
               few_postings: int = FEW_POSTINGS) -> tuple[str, int, int, int] | None:
    """The rarest word, the last of its blocks that the k best live hits can come from, and its
    postings up to there and in all; None where all are read."""
    plan = skipping(asked, index, few_postings)
    if plan is None:
        return None
    first = plan.first(FIRST_LOOK * k)
    found = _live(_matches(asked, index, (plan.term, first)), transcripts).select("rank").orderBy(
        "rank").limit(k).agg(F.count("*").alias("n"), F.max("rank").alias("worst")).head()
    last = plan.needed(found.worst if found.n == k else None)
    return plan.term, last, plan.read(last), plan.postings


def search(query: str, index: SearchIndex, segments: DataFrame, transcripts: DataFrame,
           recordings: DataFrame, limit: int | None = None,
           few_postings: int = FEW_POSTINGS) -> DataFrame:
    """Top hits of one query with snippets, best first.

    A word of more than ``few_postings`` postings is not read whole: its first blocks give the
    k-th rank there, and then only blocks that can reach it are read. Ranks are cut at the k-th
    best, ties included, so only hits that can win meet the recordings. The keys of the winners,
    100 at most, come to the driver and go back into the segment scan as a filter; a table
    sorted by recording is then read in a few row groups instead of as a whole.
    """
    k = clamp_limit(limit)
    asked = parse_query(segments.sparkSession, query, index.buckets)
    few = few_blocks(asked, index, transcripts, k, few_postings)
    live = _live(_matches(asked, index, few and few[:2]), transcripts)
    worst = live.select("rank").orderBy("rank").limit(k).agg(F.max("rank").alias("r")).scalar()
    near = live.where(F.col("rank") <= worst)
    keys = _dated(near, recordings).orderBy(*_result_order()).limit(k)
    winners = keys.collect()
    top = segments.sparkSession.createDataFrame(winners, keys.schema)
    rows = segments.where(F.col("recording_id").isin([w.recording_id for w in winners])
                          & F.col("id").isin([w.segment_id for w in winners]))
    wanted = recordings.where(F.col("id").isin([w.recording_id for w in winners]))
    shown = _details(top, rows, wanted).withColumn(
        "snippet", snippet(F.col("text"), tx.query_phrases(F.lit(query))))
    return shown.orderBy(*_result_order())


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _phrase_places(tokens: Column, phrases: Column) -> Column:
    """Per token: the first phrase it is part of and its place in it, or null."""
    def at(token: Column, i: Column) -> Column:
        def fits(words: Column, p: Column) -> Column:
            offsets = F.filter(
                F.sequence(F.lit(0), F.size(words) - 1),
                lambda o: (F.get(words, o) == token) & (i >= o) & (
                    F.slice(tokens, F.greatest(i - o, F.lit(0)) + 1, F.size(words)) == words))
            return F.transform(offsets, lambda o: F.struct(
                p.alias("phrase"), (o == 0).alias("opens"),
                (o == F.size(words) - 1).alias("closes")))
        return F.get(F.flatten(F.transform(phrases, fits)), 0)
    return F.transform(tokens, at)


def _best_window(places: Column, size: int) -> Column:
    """Start of the window with most distinct phrases, then hits, then the earliest."""
    def score(s: Column) -> Column:
        inside = F.filter(F.slice(places, s + 1, size), lambda h: h.isNotNull())
        distinct = F.array_distinct(F.transform(inside, lambda h: h["phrase"]))
        return F.struct(F.size(distinct).alias("distinct"), F.size(inside).alias("hits"),
                        (-s).alias("start"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(places) - size, F.lit(0)))
    return -F.array_max(F.transform(starts, score))["start"]


def snippet(text: Column, phrases: Column, size: int = SNIPPET_TOKENS) -> Column:
    """At most ``size`` tokens of the text around the best cluster of hits.

    Hits are set in brackets; ``...`` marks a cut. The whole text is looked at.
    """
    worded = F.filter(phrases, lambda w: F.size(w) > 0)

    def locate(t: Column) -> Column:
        return F.struct(t["raw"].alias("raw"), t["gaps"].alias("gaps"),
                        _phrase_places(t["tokens"], worded).alias("places"))

    def choose(t: Column) -> Column:
        return F.struct(t["raw"].alias("raw"), t["gaps"].alias("gaps"),
                        t["places"].alias("places"),
                        _best_window(t["places"], size).alias("start"))

    def render(t: Column) -> Column:
        start, total = t["start"], F.size(t["raw"])
        stop = F.least(start + size, total)

        def piece(i: Column) -> Column:
            hit = F.get(t["places"], i)
            gap = F.when((i > start) | (start == 0), F.get(t["gaps"], i)).otherwise("")
            return F.concat(
                gap, F.when(F.coalesce(hit["opens"], F.lit(False)), "[").otherwise(""),
                F.get(t["raw"], i),
                F.when(F.coalesce(hit["closes"], F.lit(False)), "]").otherwise(""))

        return F.concat(
            F.when(start > 0, "...").otherwise(""),
            F.array_join(F.transform(F.sequence(start, stop - 1), piece), ""),
            F.when(stop < total, F.lit("...")).otherwise(F.get(t["gaps"], total)))

    parts = F.struct(tx.raw_tokens(text).alias("raw"), tx.index_tokens(text).alias("tokens"),
                     F.split(text, tx.TOKEN_PATTERN, -1).alias("gaps"))
    shown = _let(_let(_let(parts, locate), choose), render)
    return F.when(text.rlike(tx.TOKEN_PATTERN), shown).otherwise(text)
