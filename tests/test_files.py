import json

import pytest

from sharelens.operators import pmi
from sharelens.session import collect_bounded
from sharelens.sinks import writers
from sharelens.sources import dumps, embeddings, files
from sharelens.streaming import imports


def test_dump_file_names():
    comments, submissions = dumps.dump_files("comments"), dumps.dump_files("submissions")
    assert comments[0] == "RC_2005-12.bz2" and comments[-1] == "RC_2019-12.zst" and len(comments) == 169
    assert submissions[0] == "RS_v2_2005-06.xz" and len(submissions) == 175
    assert "RS_2017-12.xz" in submissions and "RS_2018-11.zst" in submissions and "RC_2018-09.xz" in comments
    assert dumps.dump_files("comments", study_only=True)[0] == "RC_2015-01.bz2"
    assert len(dumps.dump_files("comments", year="2019")) == 12
    with pytest.raises(ValueError):
        dumps.dump_files("votes")


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


COMMENTS = [
    {"id": "c1", "parent_id": "t3_p", "author": "u", "subreddit": "s", "body": "a &amp;lt; b\r\n", "edited": False, "created_utc": "1546300800", "score": 3},
    {"id": "c2", "author": "bot", "subreddit": "s", "body": "é", "edited": 1.5, "created_utc": "x"},
    {"id": "c3", "author": "idle", "subreddit": "s", "body": "", "edited": 1546300800, "created_utc": "7"},
]


def test_comment_import(spark, tmp_path):
    write_lines(tmp_path / "RC_2019-01.json", COMMENTS)
    raw = dumps.read_dump(spark, [str(tmp_path / "RC_2019-01.json")], "comments")
    rows = {r.id: r for r in dumps.import_comments(raw).collect()}
    assert rows["t1_c1"].body == "a &lt; b\n" and rows["t1_c1"].parent_id == "t3_p" and rows["t1_c1"].created_utc == 1546300800
    assert [rows[f"t1_c{i}"].edited for i in (1, 2, 3)] == [None, None, 1546300800]
    assert rows["t1_c2"].author == "bot" and rows["t1_c2"].created_utc is None
    users = spark.createDataFrame([("u", False, True), ("bot", True, True), ("idle", False, False), ("v", None, True)], "user string, is_bot boolean, is_active boolean")
    assert [r.id for r in dumps.import_comments(raw, users).collect()] == ["t1_c1"]
    assert dumps.with_file_month(raw).select("month").distinct().first()[0] == "2019-01"


def test_submissions_and_objects(spark, tmp_path):
    write_lines(tmp_path / "s.json", [{"id": "x", "author": "u", "subreddit": "s", "selftext": "&gt;", "over_18": True, "created_utc": "5", "score": 1}])
    write_lines(tmp_path / "c.json", COMMENTS)
    raw = dumps.read_dump(spark, str(tmp_path / "s.json"), "submissions")
    row = dumps.project_submissions(raw).first()
    assert (row.id, row.parent_id, row.selftext, row.over_18) == ("t3_x", None, ">", True)
    both = dumps.import_all_objects(raw, dumps.read_dump(spark, str(tmp_path / "c.json"), "comments"))
    assert both.columns == ["id", "parent_id", "created_utc", "subreddit", "author", "score"] and both.count() == 4


def test_stream_import_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    write_lines(folder / "a.json", COMMENTS[:1])
    for new in ([], [("b.json", COMMENTS[1:])], []):
        for name, rows in new:
            write_lines(folder / name, rows)
        imports.import_new_files(spark, str(folder), "comments", table, checkpoint).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == ["t1_c1", "t1_c2", "t1_c3"]


def vectors(spark, n=200):
    rows = [(f"id{i:04d}", [float(i), 1.0], "True" if i % 4 == 0 else "False") for i in range(n)]
    return spark.createDataFrame(rows, "id string, vec array<double>, over18 string").repartition(7)


def test_embedding_files_line_up(spark, tmp_path):
    v, m = str(tmp_path / "v"), str(tmp_path / "m")
    writers.write_embedding(vectors(spark), v, m)
    schema = "host string, over18 string"
    back = embeddings.load_embedding(spark, v, m, schema, "host", normalised=False)
    assert {r.id: r.vec for r in back.collect()} == {f"id{i:04d}": [float(i), 1.0] for i in range(200)}
    safe = embeddings.load_embedding(spark, v, m, schema, "host", filter_nsfw=True)
    assert safe.count() == 150 and safe.columns == ["id", "vec", "over18"]
    length = sum(x * x for x in safe.first().vec)
    assert length == pytest.approx(1.0)


def test_row_numbers_over_several_splits(spark, tmp_path):
    """Small splits: numbers follow the lines of the files in path order."""
    for name, start in (("a.txt", 0), ("b.txt", 500)):
        (tmp_path / name).write_text("\n".join(f"line {i}" for i in range(start, start + 500)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.add_row_number(spark.read.text(str(tmp_path)))
        assert df.rdd.getNumPartitions() > 1
        assert {r.row: r.value for r in df.collect()} == {i: f"line {i}" for i in range(1000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dimension_table(spark, tmp_path):
    path = str(tmp_path / "dims")
    for name, vec in (("age", [1.0]), ("gender", [2.0])):
        row = spark.createDataFrame([(name, ["l"], ["r"], vec)], "name string, negative_comms array<string>, positive_comms array<string>, vec array<double>")
        writers.save_dimension(row, path)
    assert embeddings.load_dimensions(spark, path).count() == 2
    listed = embeddings.load_dimensions(spark, path, ["final/gender\n", "age"])
    assert [r.name for r in listed.collect()] == ["gender", "age"] and "left_comms" in listed.columns


def test_tables_are_remembered(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    tables = files.Tables(spark, str(tmp_path), cache=True)
    assert tables.load("t") is tables.load("t") and spark.table("t").count() == 3
    tables.release()
    assert not spark.catalog.tableExists("t")


def test_append_and_replace(spark, tmp_path):
    df = spark.createDataFrame([("2019-01", 1), ("2019-02", 2)], "month string, n int")
    writers.append_table(df, str(tmp_path / "a"))
    writers.append_table(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    writers.replace_months(df, str(tmp_path / "r"))
    writers.replace_months(df.where("n = 2").withColumn("n", df.n + 5), str(tmp_path / "r"))
    back = spark.read.schema(df.schema).parquet(str(tmp_path / "r"))
    assert {(r.month, r.n) for r in back.collect()} == {("2019-01", 1), ("2019-02", 7)}


def test_small_files(spark, tmp_path):
    clustering = spark.createDataFrame([('a,"b', 1, "x y"), ("c", 2, "")], "id string, cluster_id int, cluster_name string")
    writers.save_clustering(clustering, str(tmp_path / "c"))
    assert {(r.id, r.cluster_id) for r in files.load_clustering(spark, str(tmp_path / "c")).collect()} == {('a,"b', 1), ("c", 2)}
    writers.save_names(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "id string"), str(tmp_path / "n"))
    assert sorted(r.id for r in files.read_names(spark, str(tmp_path / "n")).collect()) == ["a", "b"]
    words = spark.createDataFrame([(0, "w", 3, 1.5)], "cluster int, word string, n_wc bigint, pmi double")
    writers.save_word_pmi(words, str(tmp_path / "w"))
    assert embeddings.load_word_pmi(spark, str(tmp_path / "w")).columns == ["cluster", "word", "pmi", "count"]
    writers.export_source_data({"k": words}, str(tmp_path), "fig")
    assert files.read_csv(spark, str(tmp_path / "fig_k.csv"), "cluster int, word string, n_wc int, pmi double").first().word == "w"
    blocks = spark.createDataFrame([(1, "B"), (0, "A")], "cluster int, text string")
    writers.save_report(blocks, str(tmp_path / "r"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["A", "B"]
    assert pmi.top_words_by_count(words, floor=1.0).count() == 1


def test_adhoc_query(spark):
    df = spark.range(1000).withColumnRenamed("id", "x")
    assert files.query_data(df, "x > 900", select="x * 2 AS y").count() == 99
    assert files.query_data(df, "x > 900", limit=5).count() == 5
    sampled = files.query_data(df, "x >= 0", sample=True, seed=1).count()
    assert 20 < sampled < 90


def test_bounded_collect_refuses(spark):
    with pytest.raises(ValueError):
        collect_bounded(spark.range(5), 4, "numbers")
