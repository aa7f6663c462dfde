"""URL filters: a blocked Bloom filter of listed URLs before an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import table

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [  # the lists of the registered query
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _block(key: str, blocks: int) -> str:
    return f"pmod(shiftright(xxhash64({key}), 24), {blocks})"


def _mask(key: str) -> str:
    """Four bits of one 64-bit block, from the low 24 bits of the key's hash."""
    bits = [f"shiftleft(1L, CAST(shiftright(xxhash64({key}), {6 * k}) & 63 AS INT))"
            for k in range(4)]
    return f"({' | '.join(bits)})"


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter's 64-bit blocks, in order; ``keys`` has a column ``key``."""
    words = keys.groupBy(F.expr(_block("key", blocks)).alias("block")).agg(
        F.bit_or(F.expr(_mask("key"))).alias("word"))
    every = keys.sparkSession.range(blocks).join(words, F.col("id") == F.col("block"), "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("w"))))
    return every.agg(F.transform(pairs, lambda p: p["w"]).alias("words"))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains when the
    page's path starts with the rule's. The longest rule wins (then the first in order, and
    of one listed twice the lesser verdict); a page no rule fits has a null rule and the
    ``default`` verdict.

    A page's keys are its host endings by as many labels, with its path starts of as many
    characters, as listed keys have. They are tested in the row against a blocked Bloom
    filter; only pages with a possible hit are opened and joined, on the exact key. The
    filter never passes ``max_blocks`` longs; past that it lets more false hits by, which the
    join removes. Null urls and ids are judged like others, repeated rows come back as often
    as given, other columns are not returned. A rule with a null in it fits nothing.
    """
    listed = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
              .groupBy(F.concat("host", "path").alias("key"))
              .agg(F.min(F.struct("host", "path", "verdict")).alias("listed")))
    count = listed.count()
    blocks = min(max_blocks, max(1, math.ceil(count * BITS_PER_KEY / 64)))
    shapes = listed.select(F.collect_set(F.struct(
        F.size(F.split("listed.host", r"\.")).alias("labels"),
        F.length("listed.path").alias("chars"))).alias("shapes"))
    judged = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"),
                          url_path(F.col(url)).alias("path"))
    keyed = (judged.withColumn("labels", F.split("host", r"\."))
             .withColumn("shapes", shapes.scalar())
             .withColumn("words", bloom_words(listed.select("key"), blocks).scalar())
             .withColumn("keys", F.expr("""
                transform(filter(shapes, s -> s.labels <= size(labels) AND s.chars <= length(path)),
                  s -> concat(array_join(slice(labels, size(labels) - s.labels + 1, s.labels), '.'),
                              substring(path, 1, s.chars)))"""))
             .withColumn("hits", F.expr(
                f"filter(keys, k -> (words[{_block('k', blocks)}] & {_mask('k')}) = {_mask('k')})"))
             .select("page_id", "host", "path", "hits"))
    clear = keyed.where("size(hits) = 0").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"))
    possible = (keyed.where("size(hits) > 0").groupBy("page_id", "host", "path")
                .agg(F.count("*").alias("times"), F.first("hits").alias("hits")))
    rank = F.when(F.col("listed").isNotNull(),
                  F.struct((-F.length("key")).alias("n"), F.col("key"), F.col("listed.verdict")))
    best = (possible.select("page_id", "host", "path", "times", F.explode("hits").alias("key"))
            .join(listed, "key", "left")
            .groupBy("page_id", "host", "path")
            .agg(F.max("times").alias("times"), F.min(rank).alias("best"))
            .select("page_id", "host", "path", F.col("best.key").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                    F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")))
    return clear.unionByName(best.drop("time"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP3_SQL = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1')
      THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/')
      THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""
