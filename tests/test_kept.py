"""Counts kept up to date part by part, and the bucketed store."""

import json
import random

from pyspark.sql import functions as F

from sharelens.operators import links
from sharelens.plans.views import Views
from sharelens.session import scratch_path
from sharelens.sinks import stores
from sharelens.streaming import kept_counts

SCHEMA = "author string, host string, subreddit string, month string"


def fixture():
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice(["h1", "h2", None]), rng.choice(["s", "t"]), f"2010-{rng.randint(1, 12):02d}") for _ in range(900)]
    return rows + [("heavy", "h1", "s", f"2010-{m:02d}") for m in range(1, 13) for _ in range(4)]  # over the limit only in sum


def plain(df):
    return sorted((tuple(r) for r in df.select("host", "subreddit", "count").collect()), key=repr)


def test_twelve_months_equal_one_batch(spark):
    comments = spark.createDataFrame(fixture(), SCHEMA)
    path = scratch_path(spark, "kept")
    want = plain(links.host_sub_counts(comments, 40))
    for month in [*range(1, 13), 3]:
        kept_counts.replace_parts(comments.where(F.col("month") == f"2010-{month:02d}"), path, F.col("month"))
    assert plain(kept_counts.kept_counts(spark, path, 40)) == want
    assert plain(kept_counts.kept_counts(spark, path, None)) == plain(links.host_sub_counts(comments, None))
    # a month that is corrected replaces itself
    kept_counts.replace_parts(comments.where("month = '2010-03' and author = 'a'"), path, F.col("month"))
    assert plain(kept_counts.kept_counts(spark, path, 40)) == plain(links.host_sub_counts(comments.where("month <> '2010-03' or author = 'a'"), 40))


def test_files_of_a_stream_count_once(spark, tmp_path):
    rows = fixture()
    folder, path, seen = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "seen")
    folder.mkdir()

    def deliver(name, part):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("author", "host", "subreddit", "month"), r, strict=True))) for r in part))

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(str(folder)).withColumn("part", F.col("_metadata.file_name"))
        kept_counts.keep_counting(stream, path, checkpoint).awaitTermination()
        return plain(kept_counts.kept_counts(spark, path, 40))

    deliver("one.json", rows[:300])
    deliver("two.json", rows[300:500])
    assert run(seen) == plain(links.host_sub_counts(spark.createDataFrame(rows[:500], SCHEMA), 40))
    deliver("three.json", rows[500:])
    want = plain(links.host_sub_counts(spark.createDataFrame(rows, SCHEMA), 40))
    assert run(seen) == want
    assert run(str(tmp_path / "lost")) == want  # a lost checkpoint imports every file again


def test_a_bucketed_store_needs_no_shuffle(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "posts")
    stored = stores.write_bucketed(v.comments().select("author", "host", "id"), "posts_probe", path, ["author", "host"], 8)
    for df in (stores.light_posts(stored, 3), links.pair_counts(stored)):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE posts_probe")
