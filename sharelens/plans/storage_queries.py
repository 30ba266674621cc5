"""Import and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.operators import glossary, pmi
from sharelens.plans.cluster_queries import _word_counts_sql
from sharelens.plans.registry import query
from sharelens.plans.text_queries import _DECODED
from sharelens.plans.views import STOP_WORDS, Views, long_vector
from sharelens.session import scratch_path
from sharelens.sinks import writers
from sharelens.sources import dumps, embeddings, files


def _comment_dump(v: Views):
    """Comments as a raw dump: documents as bodies, orders as authors."""
    orders = v.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    text = F.concat(F.lit("&gt; q &amp;lt; "), "text", F.lit("\r\nend &lt;b&gt;"))
    return v.documents.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("parent_id"),
        F.col("n_chars").cast("int").alias("score"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("source").alias("subreddit"),
        text.alias("body"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(False)).alias("edited"),
        F.unix_timestamp("o_orderdate").cast("string").alias("created_utc"),
        F.concat(F.lit("css"), F.col("doc_id") % 3).alias("author_flair_css_class"),
        F.when(F.col("doc_id") % 3 == 0, "flair").alias("author_flair_text"),
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("link_id"),
        F.lit("0").alias("gilded"),
        (F.col("doc_id") % 2).cast("int").alias("controversiality"),
        F.when(F.col("doc_id") % 5 == 0, "moderator").alias("distinguished"),
    )


def _submission_dump(v: Views):
    return v.pages.select(
        F.col("page_id").cast("string").alias("id"), F.lit("bot").alias("author"), "url",
        F.lit("pages").alias("subreddit"), F.lit(False).alias("over_18"), F.lit(True).alias("is_self"),
        F.col("page_id").cast("int").alias("score"), F.concat(F.lit("&lt;"), "url").alias("selftext"),
        F.lit("1546300800").alias("created_utc"),
        F.concat(F.lit("a"), F.col("page_id") % 4).alias("author_flair_css_class"),
        F.when(F.col("page_id") % 6 == 0, "admin").alias("distinguished"),
        F.lit("example.org").alias("domain"),
        F.when(F.col("page_id") % 2 == 0, 1546300900).alias("edited"),
        F.lit("1").alias("gilded"),
        F.concat(F.lit("title "), F.col("page_id")).alias("title"),
    )


_JOINED = """
    SELECT doc_id, o_custkey, source, n_chars, text, epoch(o_orderdate)::BIGINT AS t FROM documents
    JOIN orders ON o_orderkey = doc_id"""


@query(
    "dump_import",
    f"""
    SELECT 't1_' || doc_id AS id, 't3_' || doc_id AS parent_id, CAST(n_chars AS INTEGER) AS score, CAST(o_custkey AS VARCHAR) AS author,
           source AS subreddit, md5('> q &lt; ' || replace(replace(replace(replace(text, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'),
           chr(13) || chr(10), chr(10)) || chr(10) || 'end <b>') AS body, CAST(NULL AS INTEGER) AS edited, CAST(t AS INTEGER) AS created_utc,
           'css' || doc_id % 3 AS author_flair_css_class, CASE WHEN doc_id % 3 = 0 THEN 'flair' END AS author_flair_text,
           't3_' || doc_id AS link_id, '0' AS gilded, CAST(doc_id % 2 AS INTEGER) AS controversiality, CASE WHEN doc_id % 5 = 0 THEN 'moderator' END AS distinguished
    FROM ({_JOINED}) JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD'""",
)
def dump_import(v: Views):
    path = scratch_path(v.spark, "comments")
    _comment_dump(v).write.json(path)
    raw = dumps.read_dump(v.spark, path, "comments")
    found = dumps.import_comments(raw, v.users())
    return found.withColumn("body", F.md5("body"))


@query(
    "dump_submissions",
    """
    SELECT 't3_' || page_id AS id, CAST(NULL AS VARCHAR) AS parent_id, 'bot' AS author, url, 'pages' AS subreddit, false AS over_18,
           true AS is_self, CAST(page_id AS INTEGER) AS score,
           '<' || replace(replace(replace(url, '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS selftext, 1546300800 AS created_utc,
           'a' || page_id % 4 AS author_flair_css_class, CAST(NULL AS VARCHAR) AS author_flair_text, CASE WHEN page_id % 6 = 0 THEN 'admin' END AS distinguished,
           'example.org' AS domain, CASE WHEN page_id % 2 = 0 THEN 1546300900 END AS edited, '1' AS gilded, 'title ' || page_id AS title FROM pages""",
)
def dump_submissions(v: Views):
    path = scratch_path(v.spark, "submissions")
    _submission_dump(v).write.json(path)
    found = dumps.project_submissions(dumps.read_dump(v.spark, path, "submissions"))
    return found


@query(
    "all_objects",
    f"""
    SELECT 't1_' || doc_id AS id, 't3_' || doc_id AS parent_id, CAST(t AS INTEGER) AS created_utc, source AS subreddit,
           CAST(o_custkey AS VARCHAR) AS author, CAST(n_chars AS INTEGER) AS score FROM ({_JOINED})
    UNION ALL
    SELECT 't3_' || page_id, NULL, 1546300800, 'pages', 'bot', CAST(page_id AS INTEGER) FROM pages""",
)
def all_objects(v: Views):
    return dumps.import_all_objects(_submission_dump(v), _comment_dump(v))


@query(
    "embedding_roundtrip",
    """
    SELECT id, label, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x: round(x / sqrt(list_inner_product(vec, vec)), 6) + 0.0)) AS value
    FROM vectors_v WHERE label % 3 <> 0""",
)
def embedding_roundtrip(v: Views):
    folder = scratch_path(v.spark, "embedding")
    over18 = F.when(F.col("label") % 3 == 0, "True").otherwise("False")
    writers.write_embedding(v.vectors().withColumn("over18", over18), f"{folder}/vectors", f"{folder}/meta")
    back = embeddings.load_embedding(
        v.spark, f"{folder}/vectors", f"{folder}/meta", "id string, label int, over18 string", "id", filter_nsfw=True
    )
    return long_vector(back, "id", "label")


@query(
    "dimension_roundtrip",
    """
    SELECT dim, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x: round(x, 6) + 0.0)) AS value
    FROM dimensions_v WHERE dim IN ('partisan', 'age')""",
)
def dimension_roundtrip(v: Views):
    path = scratch_path(v.spark, "dimensions")
    stored = v.dimensions().join(v.stored(), "name")
    writers.save_dimension(stored, path)
    back = embeddings.load_dimensions(v.spark, path, ["final/partisan", "age\n"])
    return long_vector(back.withColumnRenamed("name", "dim"), "dim")


@query("table_roundtrip", "SELECT id, cluster_id, cluster_name FROM clustering_v")
def table_roundtrip(v: Views):
    path = scratch_path(v.spark, "clustering")
    writers.save_clustering(v.clustering(), path)
    return files.load_clustering(v.spark, path)


@query("month_table_roundtrip", "SELECT subreddit, month, last_month_user_bin, num_comments FROM activity_v")
def month_table_roundtrip(v: Views):
    path = scratch_path(v.spark, "activity")
    months = v.activity()
    writers.replace_months(months, path)
    writers.replace_months(months.where("month < '1998'"), path)
    back = v.spark.read.schema(months.schema).parquet(path)
    return back.select("subreddit", "month", "last_month_user_bin", "num_comments")


@query(
    "word_table_roundtrip",
    f"SELECT word, CAST(sum(n_wc) AS BIGINT) AS count FROM {_word_counts_sql('0', '')} GROUP BY word HAVING sum(n_wc) >= 100",
)
def word_table_roundtrip(v: Views):
    path = scratch_path(v.spark, "words")
    texts = v.documents.select(F.lit(0).alias("cluster"), F.col("text").alias("body"))
    writers.save_word_pmi(pmi.word_pmi(pmi.word_counts(texts, stop_words=STOP_WORDS), floor=100), path)
    return embeddings.load_word_pmi(v.spark, path).select("word", "count")


@query(
    "name_list_roundtrip",
    "SELECT DISTINCT subreddit AS id FROM comments_v",
)
def name_list_roundtrip(v: Views):
    folder = scratch_path(v.spark, "names")
    comments = v.comments().select("subreddit", "month")
    for name, part in (("early", comments.where("month < '1998'")), ("late", comments.where("month >= '1998'"))):
        writers.save_names(part.select(F.col("subreddit").alias("id")), f"{folder}/{name}")
    return files.read_names(v.spark, [f"{folder}/early", f"{folder}/late"]).distinct()


@query(
    "adhoc_query",
    "SELECT l_orderkey, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'",
)
def adhoc_query(v: Views):
    return files.query_data(v.lineitem, "l_quantity > 40 AND l_returnflag = 'R'", select="l_orderkey, l_quantity * 2 AS doubled")


@query(
    "adhoc_sample",
    f"""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE CAST(('0x' || left(md5(l_orderkey || '-' || l_linenumber), 8)) AS BIGINT) < {int(0.05 * 2**32)} AND l_quantity > 10
    ORDER BY l_orderkey, l_linenumber LIMIT 500""",
)
def adhoc_sample(v: Views):
    return files.query_data(
        v.lineitem,
        "l_quantity > 10",
        limit=500,
        select="l_orderkey, l_linenumber, l_quantity",
        sample=True,
        key="concat_ws('-', l_orderkey, l_linenumber)",
        order_by=["l_orderkey", "l_linenumber"],
    )


@query(
    "appended_table",
    "SELECT n_nationkey, n_name, runs FROM nation, (VALUES (1), (2)) t(runs) WHERE runs = 1 OR n_nationkey < 5",
)
def appended_table(v: Views):
    """A second append adds rows and keeps the first ones."""
    path = scratch_path(v.spark, "append")
    rows = v.nation.select("n_nationkey", "n_name")
    writers.append_table(rows.withColumn("runs", F.lit(1)), path)
    writers.append_table(rows.where("n_nationkey < 5").withColumn("runs", F.lit(2)), path)
    return v.spark.read.parquet(path)


@query(
    "monthly_files",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author
    FROM orders WHERE year(o_orderdate) = 1997""",
)
def monthly_files(v: Views):
    """One folder per month named like a dump file; the year is chosen by name, the month read back from it."""
    folder = scratch_path(v.spark, "months")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = v.orders.select(
        F.concat(F.lit("RC_"), month).alias("dump"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("author")
    )
    rows.write.partitionBy("dump").json(folder)
    wanted = [f"{folder}/dump=RC_1997-{m:02d}" for m in range(1, 13)]
    path = F.col("_metadata.file_path")
    found = dumps.read_dump(v.spark, wanted, "comments").withColumn("month", F.regexp_extract(path, r"RC_(\d{4}-\d{2})", 1))
    return found.select("month", "id", "author")


@query(
    "odd_header_csv",
    "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation",
)
def odd_header_csv(v: Views):
    """A table below a title and a header, as the census delivers it, in Latin-1."""
    path = scratch_path(v.spark, "census")
    rows = v.nation.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"'))).alias("line"), F.col("n_nationkey").alias("o"))
    head = v.spark.createDataFrame([("Table of nations,", -2), ("code,name", -1)], "line string, o int")
    text = head.unionByName(rows).orderBy("o").select("line").coalesce(1)
    text.write.option("encoding", "ISO-8859-1").text(path)
    return files.read_csv_below(v.spark, path, ["code", "name"], 1, "ISO-8859-1")


@query(
    "transposed_csv",
    "SELECT 'c' || r_regionkey AS code, r_name AS label, CAST(r_regionkey * 10 AS VARCHAR) AS value FROM region",
)
def transposed_csv(v: Views):
    """Codes, labels and values as three lines of one file."""
    path = scratch_path(v.spark, "transposed")
    order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", x.alias("x")))), lambda s: s["x"]), ",")
    key = F.col("r_regionkey").cast("string")
    lines = v.region.agg(
        order(F.concat(F.lit("c"), key)).alias("a"), order(F.col("r_name")).alias("b"), order((F.col("r_regionkey") * 10).cast("string")).alias("c")
    )
    lines.select(F.explode(F.array("a", "b", "c"))).coalesce(1).write.text(path)
    return files.read_transposed(v.spark, path, [f"c{i}" for i in range(5)])


@query(
    "attached_descriptions",
    f'SELECT h.host, {_DECODED} AS "desc" FROM (SELECT DISTINCT host FROM host_pages_v) h JOIN host_pages_v p ON p.host = h.host WHERE title <> \'\'',
)
def attached_descriptions(v: Views):
    pages = v.host_pages()
    return glossary.drop_missing(glossary.attach_descriptions(pages.select("host").distinct(), glossary.page_descriptions(pages)))
