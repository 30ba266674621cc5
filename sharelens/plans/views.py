"""Role tables (comments, vectors, labels, activity, ...) derived from the given tables.

Each view exists twice: as a DataFrame below, and as the text of a common table
expression in ``CTES`` for the SQL that checks the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharelens.functions.numeric import pearson
from sharelens.functions.text import HOST_PATTERN, TOKEN_PATTERN, extract_host, tokens
from sharelens.operators import links, stats, vectors as vec_ops
from sharelens.operators.dimensions import rebuild_dimensions
from sharelens.session import collect_bounded, settle
from sharelens.sources.files import Tables

PAIR_LIMIT = 2
HOST_FLOOR = 30
TOP_HOSTS = 500
WIDTH = 64
# (name, communities on the left, communities on the right)
STORED = [
    ("age", ["s1"], ["s2"]),
    ("gender", ["s3"], ["s4"]),
    ("partisan", ["s5"], ["s6"]),
    ("partisan_neutral", ["s5"], ["s6"]),
]
SEEDS = {"age": [("s1", "s2")], "gender": [("s3", "s4")], "mixed": [("s5", "s6"), ("s7", "s8")]}
#: Character references that every second page's description ends with, and what they stand for.
REFERENCES, REFERENCES_DECODED = " &#233;&#x27;&eacute;&notit;&#128;&nbsp", " é'é¬it;€\xa0"
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "was", "for", "with", "that", "les", "des", "la", "le", "der", "die", "und"]


def community(key: Column) -> Column:
    prefix = F.when(key % 10 == 0, F.lit("u_")).otherwise(F.lit("s"))
    return F.concat(prefix, key.cast("string"))


def site(key: Column) -> Column:
    own = F.concat(F.lit("p"), key.cast("string"), F.lit(".com"))
    return (
        F.when(key == 0, F.lit("reddit.com"))
        .when(key == 1, F.lit("old.reddit.com"))
        .when(key == 2, F.lit("new.reddit.com"))
        .otherwise(own)
    )


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = Tables(spark, sf_dir)
        self._dimensions: DataFrame | None = None
        self._binned: DataFrame | None = None
        self._words: DataFrame | None = None
        self._pairs: DataFrame | None = None
        self._counts: DataFrame | None = None
        self._host_counts: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.tables.load(name)

    def comments(self) -> DataFrame:
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        url = F.concat(F.lit("https://www."), site(F.col("l_partkey")), F.lit("/item/"), F.col("l_orderkey").cast("string"))
        rows = joined.select(
            F.col("o_custkey").cast("string").alias("author"),
            community(F.col("l_suppkey")).alias("subreddit"),
            url.alias("url"),
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"),
            F.col("l_quantity").cast("int").alias("score"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        )
        return rows.withColumn("host", extract_host(F.col("url")))

    def host_counts(self) -> DataFrame:
        """Posts per host and community; settled, since clusters and vectors both read it."""
        if self._host_counts is None:
            self._host_counts = settle(links.host_sub_counts(self.comments(), None))
        return self._host_counts

    def host_labels(self) -> DataFrame:
        return self.part.select(
            site(F.col("p_partkey")).alias("host"),
            (F.col("p_partkey") % 10).cast("int").alias("labels"),
            F.col("p_type").alias("cluster_name"),
        )

    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            community(F.col("vec_id")).alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
        )

    def clustering(self) -> DataFrame:
        return self.embeddings.select(
            community(F.col("vec_id")).alias("id"),
            F.col("label").alias("cluster_id"),
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_name"),
        )

    def stored(self) -> DataFrame:
        return self.spark.createDataFrame(
            STORED, "name string, negative_comms array<string>, positive_comms array<string>"
        )

    def dimensions(self) -> DataFrame:
        """Four dimensions, kept as local rows because several steps score with them."""
        if self._dimensions is None:
            built = rebuild_dimensions(self.stored(), self.vectors(), WIDTH)
            rows = collect_bounded(built, len(STORED), "dimensions")
            self._dimensions = self.spark.createDataFrame(rows, built.schema)
        return self._dimensions

    def scores(self, dim: str | None = None) -> DataFrame:
        dims = self.dimensions()
        return vec_ops.score(self.vectors(), dims if dim is None else dims.where(F.col("name") == dim))

    def scores_wide(self) -> DataFrame:
        return vec_ops.score_wide(self.vectors(), self.dimensions())

    def activity(self) -> DataFrame:
        return (
            self.comments()
            .withColumn("last_month_user_bin", 1 + F.col("author").cast("int") % 5)
            .groupBy("subreddit", "month", "last_month_user_bin")
            .agg(F.count(F.lit(1)).alias("num_comments"))
        )

    def echo_bins_of(self) -> DataFrame:
        z = stats.z_scores(self.scores("partisan"))
        edges = F.array(*[F.lit(e) for e in (-1.5, -0.5, 0.5, 1.5)])
        below = F.size(F.filter(edges, lambda e: e <= F.col("z"))) - 2
        return z.select(F.col("id").alias("subreddit"), below.alias("bin"))

    def author_posts(self) -> DataFrame:
        """Posts per author and community."""
        if self._counts is None:
            return self.comments().groupBy("author", "subreddit").agg(F.count(F.lit(1)).alias("n"))
        return self._counts

    def binned_comments(self) -> DataFrame:
        """Posts per author and community bin; kept, since cells and sizes both read it."""
        if self._binned is None:
            posts = self.author_posts()
            self._binned = settle(
                posts.join(self.echo_bins_of(), "subreddit").groupBy("author", "bin").agg(F.sum("n").alias("n"))
            )
        return self._binned

    def author_shares(self) -> DataFrame:
        per = [F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) / F.sum("n") for b in (-2, -1, 0, 1, 2)]
        return self.binned_comments().groupBy("author").agg(F.array(*per).alias("shares"))

    def echo_cells(self) -> DataFrame:
        """Per bin1: the mean share of bin2 among authors active in bin1."""
        shares = self.author_shares().select("author", F.posexplode("shares").alias("p1", "s1"), "shares")
        active = shares.where("s1 > 0").select((F.col("p1") - 2).alias("bin1"), F.posexplode("shares").alias("p2", "s2"))
        return active.groupBy("bin1", (F.col("p2") - 2).alias("bin2")).agg(F.avg("s2").alias("bin1_avg_frac_bin2")).where(
            "bin1_avg_frac_bin2 > 0"
        ).withColumn("dimen", F.lit("partisan"))

    def echo_bin_sizes(self) -> DataFrame:
        return self.binned_comments().groupBy("bin").agg(F.sum("n").alias("total_comments")).withColumn("dimen", F.lit("partisan"))

    def echo_community(self) -> DataFrame:
        self._counts = settle(self.author_posts())  # both sides of the join read it
        rows = self.author_posts().join(self.author_shares(), "author")
        return (
            rows.select("subreddit", "n", F.posexplode("shares").alias("p2", "s2"))
            .groupBy("subreddit", (F.col("p2") - 2).alias("bin2"))
            .agg(F.avg("s2").alias("subreddit_avg_frac_bin2"), F.sum("n").alias("total_comments"))
            .withColumn("dimen", F.lit("partisan"))
        )

    def month_pairs(self) -> DataFrame:
        lines = self.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate")
        orders = self.orders.select("o_orderkey", "o_orderdate")
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        over = lambda t: F.avg((F.col("l_quantity") > t).cast("double"))
        if self._pairs is None:
            self._pairs = settle(self._month_pairs(rows, over))
        return self._pairs

    @staticmethod
    def _month_pairs(rows: DataFrame, over) -> DataFrame:
        return rows.groupBy(
            F.date_format("o_orderdate", "yyyy-MM").alias("m1"), F.date_format("l_shipdate", "yyyy-MM").alias("m2")
        ).agg(
            pearson("l_quantity", "l_extendedprice").alias("pearson_r"),
            over(25).alias("proportion_over"),
            *[over(t).alias(f"{t / 10}") for t in (5, 15, 35)],
        )

    def community_z(self) -> DataFrame:
        z = stats.z_scores(self.scores("partisan"))
        return z.select(F.col("id").alias("subreddit"), "z")

    def cohorts(self) -> DataFrame:
        posts = settle(self.comments().groupBy("author", "month", "subreddit").agg(F.count(F.lit(1)).alias("n")))
        first = posts.groupBy("author").agg(F.substring(F.min("month"), 1, 4).alias("first_year"))
        joined = posts.join(self.community_z(), "subreddit").join(first, "author")
        return joined.groupBy("month", "first_year").agg((F.sum(F.abs("z") * F.col("n")) / F.sum("n")).alias("avg_abs_z_score"))

    def monthly_category(self) -> DataFrame:
        posts = self.comments().groupBy("month", "subreddit").agg(F.count(F.lit(1)).alias("n"))
        joined = posts.join(self.community_z(), "subreddit")
        own = F.when(F.col("z") <= -1, "left").when(F.col("z") >= 1, "right").otherwise("center")
        rows = joined.select("month", "z", "n", F.explode(F.array(F.lit("all"), own)).alias("category"))
        return rows.groupBy("month", "category").agg(
            (F.sum(F.abs("z") * F.col("n")) / F.sum("n")).alias("avg_abs_z"), F.sum("n").alias("num_comments")
        )

    def election(self) -> DataFrame:
        party = F.when(F.col("l_returnflag") == "A", "democrat").when(F.col("l_returnflag") == "R", "republican").otherwise("other")
        rows = self.lineitem.groupBy(
            F.col("l_suppkey").cast("double").alias("FIPS"), F.year("l_shipdate").alias("year"), party.alias("party")
        ).agg(F.sum(F.col("l_quantity").cast("int")).alias("candidatevotes"))
        # a county and year has three parties at most
        total = F.sum("candidatevotes").over(Window.partitionBy("FIPS", "year"))
        return (
            rows.withColumn("totalvotes", total)
            .withColumn("state", F.lit("S"))
            .withColumn("county", F.concat(F.lit("county "), F.col("FIPS").cast("int").cast("string")))
        )

    def counties(self) -> DataFrame:
        nation = self.nation.select("n_nationkey", "n_name")
        rows = self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        kind = F.when(F.col("s_suppkey") % 13 == 0, "Micropolitan Statistical Area").otherwise("Metropolitan Statistical Area")
        return rows.select(
            F.col("n_name").alias("CBSA Title"),
            kind.alias("Metropolitan/Micropolitan Statistical Area"),
            F.concat(F.lit("county "), F.col("s_suppkey").cast("string")).alias("County/County Equivalent"),
            (F.col("s_suppkey") / 1000).cast("int").alias("FIPS State Code"),
            (F.col("s_suppkey") % 1000).cast("int").alias("FIPS County Code"),
        )

    def places(self) -> DataFrame:
        """Metro areas with a community; a few nations stay unmapped."""
        return self.nation.where("n_nationkey % 6 <> 5").select(
            F.concat("n_name", F.lit(" Metro Area")).alias("place"),
            F.concat(F.lit("s"), (F.col("n_nationkey") * 30 + 1).cast("string")).alias("community"),
        )

    def income(self) -> DataFrame:
        nation = self.nation.select("n_nationkey", "n_name")
        rows = self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        table = rows.groupBy("n_name").agg(F.count(F.lit(1)).cast("string").alias("HD01_VD01"))
        return table.select(F.concat("n_name", F.lit(" Metro Area")).alias("GEO.display-label"), "HD01_VD01")

    def occupation(self, parity: int) -> DataFrame:
        rows = self.part.where(F.col("p_partkey") % 2 == parity)
        return rows.groupBy("p_brand").agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.concat(F.lit("Estimate!!Total!!"), "p_brand").alias("label"), "value"
        )

    def occupation_map(self) -> DataFrame:
        rows = self.part.groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("occ"))
        return rows.select(F.col("p_type").alias("community"), "occ")

    def words_scored(self) -> DataFrame:
        """All words with one share per dimension; settled, since several steps read them."""
        words = self.documents.select("lang", "doc_id", F.explode(tokens(F.col("text"))).alias("word"))
        counts = words.groupBy("word").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("lang") == "en").cast("double")).alias("age"),
            F.avg((F.col("doc_id") % 2 == 0).cast("double")).alias("partisan"),
        )
        if self._words is None:
            self._words = settle(counts.select("word", "age", "partisan"))
        return self._words

    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").cast("string").alias("user"),
            (F.col("c_acctbal") < 0).alias("is_bot"),
            (F.col("c_mktsegment") != "HOUSEHOLD").alias("is_active"),
        )

    def host_pages(self) -> DataFrame:
        """Pages with a description meta tag for every second page."""
        title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
        tag = F.concat(F.lit('<head><meta property="x"><meta content="'), title, F.lit(f'{REFERENCES}" name="Description">'))
        html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<head>"), tag)).otherwise(F.col("html"))
        return self.pages.select("page_id", extract_host(F.col("url")).alias("host"), html.alias("html"))

    def token_vectors(self) -> DataFrame:
        rows = self.embeddings.select(
            (F.col("vec_id") / 10).cast("bigint").alias("doc"),
            (F.col("vec_id") % 10).cast("int").alias("token"),
            F.col("embedding").cast("array<double>").alias("vec"),
            F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("layer"),
        )
        return rows.select("doc", "layer", "token", F.transform("vec", lambda x: x * F.col("layer")).alias("vec"))


def long_vector(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """Vectors as ``keys, pos, value`` rounded for comparison."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "v")).select(
        *keys, "pos", (F.round("v", 6) + 0.0).alias("value")
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    exprs = [f"round(`{c}`, {digits}) + 0.0D AS `{c}`" if c in columns else f"`{c}`" for c in df.columns]
    return df.selectExpr(*exprs)


def _dimension_rows() -> str:
    rows = []
    for name, left, right in STORED:
        sign = "1.0" if name.endswith("_neutral") else "-1.0"
        rows.append(f"('{name}', '{left[0]}', '{right[0]}', {sign})")
    return ", ".join(rows)


_COMM = "CASE WHEN {k} % 10 = 0 THEN 'u_' || {k} ELSE 's' || {k} END"
_SITE = "CASE {k} WHEN 0 THEN 'reddit.com' WHEN 1 THEN 'old.reddit.com' WHEN 2 THEN 'new.reddit.com' ELSE 'p' || {k} || '.com' END"

CTES = {
    "comments_v": f"""
        SELECT *, regexp_extract(url, '{HOST_PATTERN}', 3) AS host FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS author, {_COMM.format(k="l_suppkey")} AS subreddit,
               'https://www.' || ({_SITE.format(k="l_partkey")}) || '/item/' || l_orderkey AS url,
               l_orderkey || '-' || l_linenumber AS id, CAST(l_quantity AS INTEGER) AS score,
               strftime(o_orderdate, '%Y-%m') AS month
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "light_pairs_v": f"""
        SELECT author, host, count(*) AS n FROM comments_v GROUP BY author, host HAVING count(*) < {PAIR_LIMIT}""",
    "posts_v": """
        SELECT c.* FROM comments_v c JOIN light_pairs_v p ON c.author = p.author AND c.host = p.host""",
    "host_sub_counts_v": "SELECT host, subreddit, count(*) AS count FROM comments_v GROUP BY host, subreddit",
    "host_labels_v": f"""
        SELECT {_SITE.format(k="p_partkey")} AS host, CAST(p_partkey % 10 AS INTEGER) AS labels,
               p_type AS cluster_name FROM part""",
    "top_hosts_v": f"""
        SELECT host, CAST(sum(count) AS BIGINT) AS sum_count FROM host_sub_counts_v
        GROUP BY host ORDER BY sum_count DESC, host LIMIT {TOP_HOSTS}""",
    "vectors_v": f"""
        SELECT {_COMM.format(k="vec_id")} AS id,
               list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings""",
    "host_sums_v": """
        SELECT host, pos, sum(v * count) AS v FROM (
            SELECT c.host, c.count, unnest(v.vec) AS v, unnest(range(len(v.vec))) AS pos
            FROM host_sub_counts_v c JOIN top_hosts_v t ON c.host = t.host
            JOIN vectors_v v ON v.id = c.subreddit) GROUP BY host, pos""",
    "host_vectors_v": """
        SELECT s.host, list(s.v / n.length ORDER BY s.pos) AS vec FROM host_sums_v s
        JOIN (SELECT host, sqrt(sum(v * v)) AS length FROM host_sums_v GROUP BY host) n ON n.host = s.host
        GROUP BY s.host""",
    "all_host_sums_v": """
        SELECT host, pos, sum(v * count) AS v FROM (
            SELECT c.host, c.count, unnest(v.vec) AS v, unnest(range(len(v.vec))) AS pos
            FROM host_sub_counts_v c JOIN vectors_v v ON v.id = c.subreddit) GROUP BY host, pos""",
    "all_host_vectors_v": """
        SELECT s.host, list(s.v / n.length ORDER BY s.pos) AS vec FROM all_host_sums_v s
        JOIN (SELECT host, sqrt(sum(v * v)) AS length FROM all_host_sums_v GROUP BY host) n ON n.host = s.host
        GROUP BY s.host""",
    "clustering_v": f"""
        SELECT {_COMM.format(k="vec_id")} AS id, label AS cluster_id, 'c' || label AS cluster_name FROM embeddings""",
    "dimension_seeds_v": f"SELECT * FROM (VALUES {_dimension_rows()}) t(name, l, r, sign)",
    "dimensions_v": """
        SELECT name AS dim, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM (
            SELECT s.name, list_transform(range(1, 65), lambda i: b.vec[i] + s.sign * a.vec[i]) AS vec
            FROM dimension_seeds_v s JOIN vectors_v a ON a.id = s.l JOIN vectors_v b ON b.id = s.r)""",
    "scores_v": """
        SELECT v.id, d.dim, list_inner_product(v.vec, d.vec) AS score FROM vectors_v v CROSS JOIN dimensions_v d""",
    "moments_v": """
        SELECT dim, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd, min(score) AS low, max(score) AS high
        FROM scores_v GROUP BY dim""",
    "z_v": "SELECT s.id, s.dim, s.score, (s.score - m.mean) / m.sd AS z FROM scores_v s JOIN moments_v m ON m.dim = s.dim",
    "percentiles_v": """
        SELECT id, dim, score, 100.0 * (row_number() OVER (PARTITION BY dim ORDER BY score, id) - 1)
               / count(*) OVER (PARTITION BY dim) AS pctl FROM scores_v""",
    "members_v": "SELECT s.*, c.cluster_id, c.cluster_name FROM scores_v s JOIN clustering_v c ON c.id = s.id",
    "knn_v": """
        SELECT c1, c2, similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY similarity DESC, c2) AS rank FROM (
                SELECT a.id AS c1, b.id AS c2, round(list_inner_product(a.vec, b.vec)
                       / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 12) AS similarity
                FROM vectors_v a JOIN vectors_v b ON a.id <> b.id)) WHERE rank <= 10""",
    "activity_v": """
        SELECT subreddit, month, 1 + CAST(author AS INTEGER) % 5 AS last_month_user_bin, count(*) AS num_comments
        FROM comments_v GROUP BY 1, 2, 3""",
    "echo_bins_v": """
        SELECT id AS subreddit, (CASE WHEN z >= 1.5 THEN 2 WHEN z >= 0.5 THEN 1 WHEN z >= -0.5 THEN 0
               WHEN z >= -1.5 THEN -1 ELSE -2 END) AS bin FROM z_v WHERE dim = 'partisan'""",
    "binned_comments_v": """
        SELECT c.author, c.subreddit, b.bin, count(*) AS n FROM comments_v c
        JOIN echo_bins_v b ON b.subreddit = c.subreddit GROUP BY 1, 2, 3""",
    "author_shares_v": """
        SELECT author, b.bin, sum(CASE WHEN c.bin = b.bin THEN n ELSE 0 END) / sum(n) AS share
        FROM binned_comments_v c CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) b(bin) GROUP BY author, b.bin""",
    "echo_cells_v": """
        SELECT a.bin AS bin1, b.bin AS bin2, avg(b.share) AS value FROM author_shares_v a
        JOIN author_shares_v b ON a.author = b.author WHERE a.share > 0 GROUP BY 1, 2 HAVING avg(b.share) > 0""",
    "echo_pct_v": """
        SELECT bin, sum(n) AS total_comments, sum(n) / (SELECT sum(n) FROM binned_comments_v) AS pct
        FROM binned_comments_v GROUP BY bin""",
    "echo_community_v": """
        SELECT c.subreddit, s.bin AS bin2, avg(s.share) AS frac, CAST(sum(c.n) AS BIGINT) AS total_comments FROM
        (SELECT subreddit, author, count(*) AS n FROM comments_v GROUP BY 1, 2) c
        JOIN author_shares_v s ON s.author = c.author GROUP BY 1, 2""",
    "month_pairs_v": """
        SELECT strftime(o_orderdate, '%Y-%m') AS m1, strftime(l_shipdate, '%Y-%m') AS m2,
               CASE WHEN isnan(corr(l_quantity, l_extendedprice)) THEN NULL ELSE corr(l_quantity, l_extendedprice) END AS pearson_r,
               avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS proportion_over,
               avg(CASE WHEN l_quantity > 5 THEN 1.0 ELSE 0.0 END) AS t1,
               avg(CASE WHEN l_quantity > 15 THEN 1.0 ELSE 0.0 END) AS t2,
               avg(CASE WHEN l_quantity > 35 THEN 1.0 ELSE 0.0 END) AS t3
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "community_z_v": "SELECT id AS subreddit, z FROM z_v WHERE dim = 'partisan'",
    "cohorts_v": """
        SELECT c.month, f.first_year, avg(abs(z.z)) AS avg_abs_z_score FROM comments_v c
        JOIN community_z_v z ON z.subreddit = c.subreddit
        JOIN (SELECT author, substr(min(month), 1, 4) AS first_year FROM comments_v GROUP BY author) f
          ON f.author = c.author GROUP BY 1, 2""",
    "monthly_category_v": """
        SELECT month, category, avg(abs(z)) AS avg_abs_z, count(*) AS num_comments FROM (
            SELECT month, z, unnest(['all', CASE WHEN z <= -1 THEN 'left' WHEN z >= 1 THEN 'right' ELSE 'center' END]) AS category
            FROM comments_v c JOIN community_z_v z ON z.subreddit = c.subreddit) GROUP BY 1, 2""",
    "places_v": """
        SELECT n_name || ' Metro Area' AS place, 's' || (n_nationkey * 30 + 1) AS community
        FROM nation WHERE n_nationkey % 6 <> 5""",
    "income_v": """
        SELECT n_name || ' Metro Area' AS label, CAST(count(*) AS DOUBLE) AS income
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "income_map_v": """
        SELECT p.community, i.label, i.income AS y FROM income_v i JOIN places_v p ON p.place = i.label
        JOIN vectors_v v ON v.id = p.community""",
    "county_votes_v": """
        SELECT l_suppkey AS fips, year(l_shipdate) AS year,
               sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) END) AS votes_dem,
               sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) END) AS votes_rep,
               sum(CAST(l_quantity AS INTEGER)) AS votes_total
        FROM lineitem WHERE year(l_shipdate) IN (1996, 1998, 2000) GROUP BY 1, 2""",
    "election_v": """
        SELECT year, p.community, p.place AS label, CAST(sum(votes_dem) AS BIGINT) AS votes_dem,
               CAST(sum(votes_rep) AS BIGINT) AS votes_rep, CAST(sum(votes_total) AS BIGINT) AS votes_total,
               (sum(votes_rep) - sum(votes_dem)) * 100.0 / sum(votes_total) AS y
        FROM county_votes_v JOIN supplier ON s_suppkey = fips AND s_suppkey % 13 <> 0
        JOIN nation ON n_nationkey = s_nationkey JOIN places_v p ON p.place = n_name || ' Metro Area'
        GROUP BY 1, 2, 3""",
    "occupation_v": """
        SELECT p_brand AS occupation, sum(1 - p_partkey % 2) AS value_f, sum(p_partkey % 2) AS value_m FROM part GROUP BY 1""",
    "occupation_share_v": """
        SELECT m.community, string_agg(m.occ, '; ' ORDER BY m.occ) AS label, CAST(sum(value_f) AS BIGINT) AS value_f,
               CAST(sum(value_m) AS BIGINT) AS value_m, sum(value_f) / sum(value_f + value_m) AS y
        FROM (SELECT DISTINCT p_type AS community, p_brand AS occ FROM part) m
        JOIN occupation_v o ON o.occupation = m.occ GROUP BY 1""",
    "tokens_v": f"""
        SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}', 1)) AS word FROM documents""",
    "words_scored_v": """
        SELECT word, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS age,
               avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS partisan
        FROM tokens_v GROUP BY word""",
    "host_pages_v": f"""
        SELECT page_id, regexp_extract(url, '{HOST_PATTERN}', 3) AS host, CASE WHEN page_id % 2 = 0
               THEN regexp_extract(html, '<title>([^<]*)</title>', 1) || '{REFERENCES}' ELSE '' END AS title FROM pages""",
}


def with_views(select: str, recursive: str = "") -> str:
    """Prefix a SELECT with the views it names, dependencies first.

    ``recursive`` is the text of further (recursive) table expressions.
    """
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                ordered.append(name)

    visit(select + recursive)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered] + [recursive] * bool(recursive)
    if not parts:
        return select
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
