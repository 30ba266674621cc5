"""Clusters, PMI, words and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.functions import text as T
from sharelens.operators import clusters, pmi, report, ward
from sharelens.plans.registry import query
from sharelens.plans.vector_queries import host_vectors_of
from sharelens.plans.views import STOP_WORDS, WIDTH, Views, long_vector, rounded

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_URLS_SQL = f"{T.BARE_DOMAIN_PATTERN}|{T.HTTP_URL_PATTERN}"
COMMUNITY_FLOOR = 100


def labelled_counts(v: Views):
    return clusters.with_labels(v.host_counts(), v.host_labels().select("host", "labels"))


_LABELLED = """(SELECT c.host, c.subreddit, c.count, l.labels FROM host_sub_counts_v c
                JOIN host_labels_v l ON l.host = c.host)"""
_PMI = f"""
    (SELECT xy.labels, xy.subreddit, xy.count, x.labels_count, y.subreddit_count,
            ln(n.n * xy.count / (x.labels_count * y.subreddit_count)) AS pmi
     FROM (SELECT labels, subreddit, CAST(sum(count) AS DOUBLE) AS count FROM {_LABELLED} GROUP BY 1, 2) xy
     JOIN (SELECT labels, CAST(sum(count) AS DOUBLE) AS labels_count FROM {_LABELLED} GROUP BY 1) x USING (labels)
     JOIN (SELECT subreddit, CAST(sum(count) AS DOUBLE) AS subreddit_count FROM {_LABELLED} GROUP BY 1) y USING (subreddit)
     CROSS JOIN (SELECT CAST(sum(count) AS DOUBLE) AS n FROM {_LABELLED}) n
     WHERE NOT contains(xy.subreddit, 'u_'))"""


@query(
    "pmi_pairs",
    f"""
    SELECT labels, subreddit, CAST(count AS BIGINT) AS count, CAST(labels_count AS BIGINT) AS labels_count,
           CAST(subreddit_count AS BIGINT) AS subreddit_count, round(pmi, 6) + 0.0 AS pmi FROM {_PMI}""",
)
def pmi_pairs(v: Views):
    return rounded(pmi.pmi(labelled_counts(v), "labels", "subreddit"), "pmi")


@query(
    "top_per_cluster",
    f"""
    SELECT * FROM (
        SELECT 'pmi' AS list, labels, subreddit AS item, rank() OVER (PARTITION BY labels ORDER BY round(pmi, 9) DESC, subreddit) AS rank
        FROM {_PMI} WHERE subreddit_count > {COMMUNITY_FLOOR}
        UNION ALL
        SELECT 'posts', labels, subreddit, rank() OVER (PARTITION BY labels ORDER BY subreddit_count DESC, subreddit)
        FROM {_PMI} WHERE pmi > 0
        UNION ALL
        SELECT 'hosts', labels, host, rank() OVER (PARTITION BY labels ORDER BY count DESC, host)
        FROM (SELECT labels, host, sum(count) AS count FROM {_LABELLED} GROUP BY 1, 2)) WHERE rank <= 10""",
)
def top_per_cluster(v: Views):
    counts = labelled_counts(v)
    pairs = pmi.pmi(counts, "labels", "subreddit").withColumn("pmi", F.round("pmi", 9))
    parts = [
        ("pmi", "subreddit", pmi.top_communities_by_pmi(pairs, floor=COMMUNITY_FLOOR)),
        ("posts", "subreddit", pmi.top_communities_by_posts(pairs, floor=0.0)),
        ("hosts", "host", clusters.top_hosts_per_cluster(counts)),
    ]
    rows = [df.select(F.lit(name).alias("list"), "labels", F.col(item).alias("item"), "rank") for name, item, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "remove_urls_tokens",
    f"""
    SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '{_URLS_SQL}', '', 'g')), '{T.TOKEN_PATTERN}', 1)) AS word
        FROM documents) WHERE regexp_full_match(word, '[a-z]+') GROUP BY word""",
)
def remove_urls_tokens(v: Views):
    words = v.documents.select(F.explode(T.tokens(T.remove_urls(F.col("text")), latin_only=True)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_LONG_TEXT = "concat('http://www.site', doc_id, '.com/a?b=c ', text, ' end.of', doc_id, ' x')"
def _word_counts_sql(cluster: str, vocabulary: str) -> str:
    return f"""
    (SELECT cluster, word, count(*) AS n_wc FROM (
        SELECT {cluster} AS cluster, unnest(regexp_extract_all(lower(regexp_replace(text, '{_URLS_SQL}', '', 'g')),
               '{T.TOKEN_PATTERN}', 1)) AS word FROM documents)
     WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ({_STOP_SQL}) {vocabulary} GROUP BY 1, 2)"""


_VOCABULARY = f"""AND word IN (SELECT unnest(regexp_extract_all(lower(text), '{T.TOKEN_PATTERN}', 1)) FROM benchmark)"""


def _word_pmi_sql(cluster: str, vocabulary: str, floor: int) -> str:
    counts = _word_counts_sql(cluster, vocabulary)
    return f"""
    (SELECT cluster, word, n_wc, w.n_w, c.n_c, ln(n.n * n_wc / (CAST(c.n_c AS DOUBLE) * w.n_w)) AS pmi
     FROM {counts}
     JOIN (SELECT word, CAST(sum(n_wc) AS BIGINT) AS n_w FROM {counts} GROUP BY word HAVING sum(n_wc) >= {floor}) w USING (word)
     JOIN (SELECT cluster, CAST(sum(n_wc) AS BIGINT) AS n_c FROM {counts} GROUP BY cluster) c USING (cluster)
     CROSS JOIN (SELECT CAST(sum(n_wc) AS DOUBLE) AS n FROM {counts}) n)"""


@query(
    "url_free_text",
    f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
        SELECT doc_id, regexp_replace({_LONG_TEXT}, '{_URLS_SQL}', '', 'g') AS t FROM documents)""",
)
def url_free_text(v: Views):
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("http://www.site"), key, F.lit(".com/a?b=c "), "text", F.lit(" end.of"), key, F.lit(" x"))
    clean = v.documents.select("doc_id", T.remove_urls(text).alias("t"))
    return clean.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def vocabulary_of(v: Views):
    return v.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()


@query(
    "cluster_word_pmi",
    f"""
    SELECT cluster, word, n_wc, n_w, n_c, round(pmi, 6) + 0.0 AS pmi
    FROM {_word_pmi_sql('lang', _VOCABULARY, 100)}""",
)
def cluster_word_pmi(v: Views):
    texts = v.documents.select(F.col("lang").alias("cluster"), F.col("text").alias("body"))
    counts = pmi.word_counts(texts, stop_words=STOP_WORDS, vocabulary=vocabulary_of(v))
    return rounded(pmi.word_pmi(counts, floor=100), "pmi")


_REPORT_WORDS = _word_pmi_sql("CAST(doc_id % 10 AS INTEGER)", "", 20)


def report_words(v: Views):
    texts = v.documents.select((F.col("doc_id") % 10).cast("int").alias("cluster"), F.col("text").alias("body"))
    words = pmi.word_pmi(pmi.word_counts(texts, stop_words=STOP_WORDS), floor=20)
    return words.withColumn("pmi", F.round("pmi", 9))


@query(
    "top_words",
    f"""
    SELECT * FROM (
        SELECT 'pmi' AS list, cluster, word, rank() OVER (PARTITION BY cluster ORDER BY round(pmi, 9) DESC, word) AS rank
        FROM {_REPORT_WORDS} WHERE n_wc > 10
        UNION ALL
        SELECT 'count', cluster, word, rank() OVER (PARTITION BY cluster ORDER BY n_wc DESC, word)
        FROM {_REPORT_WORDS} WHERE round(pmi, 9) > 0.1) WHERE rank <= 10""",
)
def top_words(v: Views):
    words = report_words(v)
    by_pmi = pmi.top_words_by_pmi(words, floor=10).select(F.lit("pmi").alias("list"), "cluster", "word", "rank")
    by_count = pmi.top_words_by_count(words, floor=0.1).select(F.lit("count").alias("list"), "cluster", "word", "rank")
    return by_pmi.unionByName(by_count)


@query(
    "cluster_sizes",
    "SELECT cluster_id, cluster_name, count(*) AS size FROM clustering_v GROUP BY 1, 2",
)
def cluster_sizes(v: Views):
    return clusters.cluster_sizes(v.clustering())


@query("cluster_labels", "SELECT DISTINCT cluster_id FROM clustering_v")
def cluster_labels(v: Views):
    return clusters.distinct_labels(v.clustering())


@query(
    "named_clusters",
    """
    SELECT id, cluster_id AS label, CASE cluster_id WHEN 0 THEN 'Europe' WHEN 1 THEN 'Hockey' WHEN 2 THEN 'Science' ELSE '' END
           AS cluster_name FROM clustering_v""",
)
def named_clusters(v: Views):
    rows = v.clustering().select("id", F.col("cluster_id").alias("label"))
    return clusters.name_clusters(rows, {0: "Europe", 1: "Hockey", 2: "Science"})


_CENTROIDS = """
    (SELECT label, list(m ORDER BY pos) AS vec, any_value(size) AS size FROM (
        SELECT label, pos, avg(v) AS m, count(*) AS size FROM (
            SELECT label, unnest(vec) AS v, unnest(range(64)) AS pos FROM vectors_v) GROUP BY 1, 2) GROUP BY label)"""


@query(
    "centroids",
    f"""
    SELECT label, size, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x: round(x, 6) + 0.0)) AS value
    FROM {_CENTROIDS}""",
)
def centroids(v: Views):
    return long_vector(clusters.centroids(v.vectors(), width=WIDTH), "label", "size")


def _closest_sql(cosine: bool, all_vecs: bool) -> str:
    value = "list_cosine_similarity(v.vec, c.vec)" if cosine else "list_distance(v.vec, c.vec)"
    return f"""
    SELECT centre, id, label, rank, round(value, 6) + 0.0 AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY centre ORDER BY value {'DESC' if cosine else ''}, id) AS rank FROM (
            SELECT c.label AS centre, v.id, v.label, round({value}, 12) AS value
            FROM vectors_v v JOIN {_CENTROIDS} c ON {'true' if all_vecs else 'v.label = c.label'})) WHERE rank <= 10"""


@query("closest_to_centroid", _closest_sql(True, True))
def closest_to_centroid(v: Views):
    centres = clusters.centroids(v.vectors(), width=WIDTH)
    return rounded(clusters.closest_to_centroid(v.vectors(), centres), "value")


@query("closest_in_cluster", _closest_sql(False, False))
def closest_in_cluster(v: Views):
    centres = clusters.centroids(v.vectors(), width=WIDTH)
    return rounded(clusters.closest_to_centroid(v.vectors(), centres, cosine=False, all_vecs=False), "value")


def _odd_vectors(v: Views):
    """Every seventh vector has no direction, every fifth no label."""
    zero = F.transform("vec", lambda x: x * 0)
    key = F.regexp_replace("id", "[^0-9]", "").cast("int")
    return v.vectors().select(
        "id", F.when(key % 7 == 0, zero).otherwise(F.col("vec")).alias("vec"), F.when(key % 5 == 0, None).otherwise(F.col("label")).alias("label")
    )


_ODD = """
    (SELECT id, CASE WHEN k % 7 = 0 THEN list_transform(vec, lambda x: x * 0) ELSE vec END AS vec, CASE WHEN k % 5 <> 0 THEN label END AS label
     FROM (SELECT *, CAST(regexp_replace(id, '[^0-9]', '', 'g') AS INTEGER) AS k FROM vectors_v))"""


@query(
    "closest_with_gaps",
    f"""
    SELECT centre, id, label, rank, round(value, 6) + 0.0 AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY centre ORDER BY value DESC, id) AS rank FROM (
            SELECT c.label AS centre, v.id, v.label, round(list_cosine_similarity(v.vec, c.vec), 12) AS value
            FROM {_ODD} v JOIN {_CENTROIDS} c ON true WHERE list_inner_product(v.vec, v.vec) > 0)) WHERE rank <= 10""",
)
def closest_with_gaps(v: Views):
    centres = clusters.centroids(v.vectors(), width=WIDTH)
    return rounded(clusters.closest_to_centroid(_odd_vectors(v), centres), "value")


_WARD_STEPS = """
    ward_w(step, a, b, na, nb, cost) AS (
        SELECT 0, x.host, y.host, 1.0::DOUBLE, 1.0::DOUBLE,
               (list_inner_product(x.vec, x.vec) + list_inner_product(y.vec, y.vec) - 2 * list_inner_product(x.vec, y.vec)) / 2
        FROM host_vectors_v x JOIN host_vectors_v y ON x.host < y.host
        UNION ALL
        SELECT step + 1, k1, k2, max(n1), max(n2), sum(part) FROM (
            SELECT step, CASE WHEN k IS NULL THEN a ELSE least(i, k) END AS k1, CASE WHEN k IS NULL THEN b ELSE greatest(i, k) END AS k2,
                   CASE WHEN k IS NULL THEN na WHEN i < k THEN ni + nj ELSE nk END AS n1, CASE WHEN k IS NULL THEN nb WHEN i < k THEN nk ELSE ni + nj END AS n2,
                   CASE WHEN k IS NULL THEN cost WHEN i IN (a, b) THEN ((nk + ni) * cost - nk * c) / (nk + ni + nj) ELSE (nk + nj) * cost / (nk + ni + nj) END AS part
            FROM (SELECT *, CASE WHEN a IN (i, j) THEN b WHEN b IN (i, j) THEN a END AS k, CASE WHEN a IN (i, j) THEN nb ELSE na END AS nk
                  FROM ward_w, (SELECT a AS i, b AS j, na AS ni, nb AS nj, cost AS c FROM ward_w ORDER BY cost, a, b LIMIT 1)
                  WHERE NOT (a = i AND b = j))) GROUP BY step, k1, k2)"""


@query(
    "ward_tree",
    """
    SELECT a AS low, b AS high, round(cost, 6) + 0.0 AS height, CAST(na + nb AS BIGINT) AS size
    FROM ward_w QUALIFY row_number() OVER (PARTITION BY step ORDER BY cost, a, b) = 1""",
    recursive=_WARD_STEPS,
)
def ward_tree(v: Views):
    hosts = host_vectors_of(v).withColumnRenamed("host", "id")
    return rounded(ward.ward_tree(hosts), "height").select("low", "high", "height", "size")


@query("cluster_hosts")
def cluster_hosts(v: Views):
    hosts = host_vectors_of(v, None).withColumnRenamed("host", "id")
    return clusters.cluster_vectors(hosts, clusters=20)


@query("cluster_hosts_kmeans")
def cluster_hosts_kmeans(v: Views):
    hosts = host_vectors_of(v, None).withColumnRenamed("host", "id")
    return clusters.cluster_vectors(hosts, clusters=20, method="kmeans")


def report_of(v: Views):
    counts = labelled_counts(v)
    pairs = pmi.pmi(counts, "labels", "subreddit").withColumn("pmi", F.round("pmi", 9))
    hosts = host_vectors_of(v, None).join(v.host_labels(), "host").select(F.col("host").alias("id"), "vec", F.col("labels").alias("label"))
    closest = clusters.closest_to_centroid(hosts, clusters.centroids(hosts, width=WIDTH))
    words = report_words(v)
    sections = [
        report.section(pmi.top_communities_by_pmi(pairs, floor=COMMUNITY_FLOOR), "pmi", "labels", "subreddit", "pmi", "subreddit_count"),
        report.section(pmi.top_communities_by_posts(pairs, floor=0.0), "posts", "labels", "subreddit", "subreddit_count", "pmi"),
        report.section(clusters.top_hosts_per_cluster(counts), "hosts", "labels", "host", "count"),
        report.section(closest, "closest", "centre", "id", "label", "value"),
        report.section(pmi.top_words_by_pmi(words, floor=10), "word_pmi", "cluster", "word", "pmi", "n_wc"),
        report.section(pmi.top_words_by_count(words, floor=0.1), "word_count", "cluster", "word", "n_wc", "pmi"),
    ]
    labels = v.host_labels().select(F.col("labels").alias("cluster")).distinct()
    return report.cluster_report(labels, sections)


_HOST_CENTROIDS = """
    (SELECT labels, list(m ORDER BY pos) AS vec FROM (
        SELECT labels, pos, avg(v) AS m FROM (
            SELECT l.labels, unnest(h.vec) AS v, unnest(range(64)) AS pos
            FROM all_host_vectors_v h JOIN host_labels_v l ON l.host = h.host) GROUP BY 1, 2) GROUP BY labels)"""


_REPORT = f"""
    SELECT g.cluster, g.section, g.rank, coalesce(r.item, 'N/A') AS item, round(r.v1, 6) + 0.0 AS v1, round(r.v2, 6) + 0.0 AS v2
    FROM (SELECT cluster, unnest(['pmi', 'posts', 'hosts', 'closest', 'word_pmi', 'word_count']) AS section, rank
          FROM (SELECT DISTINCT labels AS cluster FROM host_labels_v), (SELECT unnest(range(1, 11)) AS rank)) g
    LEFT JOIN (
        SELECT 'pmi' AS section, labels AS cluster, subreddit AS item, round(pmi, 9) AS v1, subreddit_count AS v2,
               row_number() OVER (PARTITION BY labels ORDER BY round(pmi, 9) DESC, subreddit) AS rank
        FROM {_PMI} WHERE subreddit_count > {COMMUNITY_FLOOR}
        UNION ALL
        SELECT 'posts', labels, subreddit, subreddit_count, round(pmi, 9),
               row_number() OVER (PARTITION BY labels ORDER BY subreddit_count DESC, subreddit) FROM {_PMI} WHERE round(pmi, 9) > 0
        UNION ALL
        SELECT 'hosts', labels, host, count, NULL, row_number() OVER (PARTITION BY labels ORDER BY count DESC, host)
        FROM (SELECT labels, host, CAST(sum(count) AS DOUBLE) AS count FROM {_LABELLED} GROUP BY 1, 2)
        UNION ALL
        SELECT 'closest', c.labels, h.host, l.labels, round(list_cosine_similarity(h.vec, c.vec), 12),
               row_number() OVER (PARTITION BY c.labels ORDER BY round(list_cosine_similarity(h.vec, c.vec), 12) DESC, h.host)
        FROM all_host_vectors_v h JOIN host_labels_v l ON l.host = h.host CROSS JOIN {_HOST_CENTROIDS} c
        UNION ALL
        SELECT 'word_pmi', cluster, word, round(pmi, 9), n_wc,
               row_number() OVER (PARTITION BY cluster ORDER BY round(pmi, 9) DESC, word) FROM {_REPORT_WORDS} WHERE n_wc > 10
        UNION ALL
        SELECT 'word_count', cluster, word, n_wc, round(pmi, 9),
               row_number() OVER (PARTITION BY cluster ORDER BY n_wc DESC, word) FROM {_REPORT_WORDS} WHERE round(pmi, 9) > 0.1
    ) r ON r.cluster = g.cluster AND r.section = g.section AND r.rank = g.rank"""


@query("cluster_report", _REPORT)
def cluster_report(v: Views):
    return rounded(report_of(v), "v1", "v2")


def _line_sql(section: str, first: str, second: str | None, whole_first: bool, label: str = "Subreddit") -> str:
    number = lambda c, whole: f"CASE WHEN {c} IS NULL THEN 'N/A' WHEN {str(whole).lower()} THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE printf('%.6f', {c}) END"
    text = f"rank || ' - {label}: ' || item || ', {first}: ' || {number('v1', whole_first)}"
    if second:
        text += f" || ', {second}: ' || {number('v2', not whole_first)}"
    return f"WHEN section = '{section}' THEN {text}"


_TITLES = "CASE section " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.SECTIONS.items()) + " END"
_PLACES = "list_position([" + ", ".join(f"'{k}'" for k in report.SECTIONS) + "], section)"
_TEXT = f"""
    SELECT cluster, '----------Cluster: ' || cluster || ' (Desc: ' || cluster_name || '), Size: ' || size || '----------' || chr(10)
           || string_agg(CASE WHEN rank = 1 THEN {_TITLES} || chr(10) ELSE '' END || line, chr(10) ORDER BY {_PLACES}, rank) || chr(10) AS text
    FROM (SELECT *, CASE {_line_sql("pmi", "PMI", "Subreddit count", False)} {_line_sql("posts", "Subreddit count", "PMI", True)}
          {_line_sql("hosts", "Post Count", None, True, "Host")} {_line_sql("closest", "Label", "Distance", True, "Host")}
          {_line_sql("word_pmi", "PMI to cluster", "Count in cluster", False, "Word")} {_line_sql("word_count", "Count in cluster", "PMI in cluster", True, "Word")}
          END AS line FROM ({_REPORT}))
    JOIN (SELECT labels AS cluster, min(cluster_name) AS cluster_name, count(*) AS size FROM host_labels_v GROUP BY 1) USING (cluster)
    GROUP BY cluster, cluster_name, size"""


@query("cluster_report_text", _TEXT)
def cluster_report_text(v: Views):
    sizes = v.host_labels().groupBy(F.col("labels").alias("cluster")).agg(
        F.min("cluster_name").alias("cluster_name"), F.count(F.lit(1)).alias("size")
    )
    return report.report_text(rounded(report_of(v), "v1", "v2"), sizes)
