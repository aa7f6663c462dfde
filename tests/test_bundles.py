"""Documents bundled into few files give the rows that a file each would."""

import os

from conftest import rows
from pyspark.sql import functions as F

from reelgrid.sources import documents as dc
from reelgrid.streaming import landing


def _files(path):
    return [f for _, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]


def test_landed_bundles(spark, tmp_path):
    """A batch lands 600 transcripts from few files; the later batch replaces, a damaged one fails."""
    def land(name, docs):
        dc.write_bundles(docs, f"{tmp_path}/files/{name}")
        landing.start_landing(spark, f"{tmp_path}/files/*", f"{tmp_path}/library", f"{tmp_path}/c",
                              bundles=True).trigger(availableNow=True).start().awaitTermination()

    docs = spark.range(600).select(
        F.concat(F.lit("rec="), F.col("id"), F.lit("/t.json")).alias("path"),
        F.concat(F.lit('{"segments":[{"start":0.5,"end":1,"text":"word '), F.col("id"), F.lit('"}]}')).alias("json"))
    land("one", docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(_files(f"{tmp_path}/files")) <= tasks
    land("two", docs.limit(3).withColumn("json", F.lit("{broken\n")))
    found = landing.current_transcripts(spark, f"{tmp_path}/library")
    assert found.count() == 600 and found.where("status = 'failed'").count() == 3
    assert landing.current_segments(spark, f"{tmp_path}/library").count() == 597
    assert {r.recording_id for r in found.collect()} == {str(n) for n in range(600)}


def test_bundled_manifests(spark, tmp_path):
    """The same manifests as files and as rows of a bundle."""
    good = ('{"format":"f","status":"completed","codec":"c","container":"m","width":4,"height":2,"frameRate":30,'
            '"frameCount":5,"durationMs":1000,"thumbnailFramePath":"t",\n"chunks":[{"path":"p","frameCount":5}]}')
    texts = [good, good.replace('"f"', '"other"'), good[:40], good.replace('"durationMs":1000,', ""), "", "[]",
             good.replace("completed", "odd"), good.replace('"width":4', '"width":"wide"')]
    for n, text in enumerate(texts):
        os.makedirs(f"{tmp_path}/files/{n}")
        with open(f"{tmp_path}/files/{n}/manifest.json", "w") as f:
            f.write(text)
    name = F.regexp_extract("manifest_path", "([^/]+)/[^/]+$", 1).alias("name")
    whole = dc.read_manifests(spark, f"{tmp_path}/files/*", "f").select("*", name).drop("manifest_path")
    dc.write_bundles(spark.createDataFrame(
        [(f"{n}/manifest.json", t) for n, t in enumerate(texts)], dc.BUNDLE), f"{tmp_path}/bundle")
    bundled = dc.bundled_manifests(dc.read_bundles(spark, f"{tmp_path}/bundle"), "f").select("*", name).drop("manifest_path")
    assert whole.columns == bundled.columns and [r[-1] for r in rows(whole, "name")] == ["0"]
    assert rows(whole, "name") == rows(bundled, "name")
