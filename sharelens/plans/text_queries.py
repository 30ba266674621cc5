"""Page descriptions and the glossary."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.functions import text as T
from sharelens.functions.numeric import truncate_clamp
from sharelens.operators import glossary as ops
from sharelens.operators import stats
from sharelens.operators.positions import slice_positions, with_position
from sharelens.plans.registry import query
from sharelens.plans.views import REFERENCES, REFERENCES_DECODED, Views

# titles hold a few references, the last of them cut off at times; the ones that the view adds are replaced as a whole
_DECODED = (
    f"CASE WHEN title <> '' THEN regexp_replace(replace(replace(replace(replace(replace(replace(title, '{REFERENCES}', ''), '&lt;', '<'), "
    "'&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '&amp$', '&') || '" + REFERENCES_DECODED.replace("'", "''") + "' ELSE '' END"
)


@query("page_descriptions", f'SELECT page_id, host, {_DECODED} AS "desc" FROM host_pages_v')
def page_descriptions(v: Views):
    pages = v.host_pages()
    return pages.select("page_id", "host", T.page_description(F.col("html")).alias("desc"))


@query(
    "host_description_slice",
    f"""
    SELECT page_id, host, {_DECODED} AS "desc" FROM (SELECT *, row_number() OVER (ORDER BY host, page_id) - 1 AS p
    FROM host_pages_v) WHERE p >= 20 AND title <> ''""",
)
def host_description_slice(v: Views):
    placed = with_position(v.host_pages().select("page_id", "host"), ["host", "page_id"])
    wanted = slice_positions(placed, 20)
    described = v.host_pages().select("page_id", T.page_description(F.col("html")).alias("desc"))
    return ops.drop_missing(wanted.join(described, "page_id", "left")).select("page_id", "host", "desc")


def _raw_description(v: Views):
    """Document text with markdown marks, a link and a non-Latin character in front."""
    mark = F.concat(F.lit("# [r/x_"), F.col("doc_id").cast("string"), F.lit("](http://a.b/c) *b* 漢{50%} "), "text")
    return v.documents.select("doc_id", mark.alias("description"))


_CLEAN = (
    "regexp_replace(regexp_replace(translate('# [r/x_' || doc_id || '](http://a.b/c) *b* 漢{50%} ' || text, '#*', '  '), "
    "'\\[(.*?)\\]\\(.*?\\)', '\\1', 'g'), "
    "'[^\\x{00}-\\x{7F}\\x{80}-\\x{FF}\\x{100}-\\x{17F}\\x{180}-\\x{24F}\\x{1E00}-\\x{1EFF}]', '', 'g')"
)


def _tex_sql(text: str) -> str:
    steps = [("\\", "chr(1)"), ("{", "'\\{'"), ("}", "'\\}'")]
    steps += [(c, f"'\\{c}'") for c in "&%$#_"]
    steps += [("~", "'\\textasciitilde{}'"), ("^", "'\\^{}'"), ("<", "'\\textless{}'"), (">", "'\\textgreater{}'")]
    for old, new in steps:
        text = f"replace({text}, '{old}', {new})"
    return f"replace({text}, chr(1), '\\textbackslash{{}}')"


@query(
    "glossary_clean",
    f"SELECT doc_id, length(c) AS n_chars, md5(c) AS clean, md5({_tex_sql('c')}) AS tex FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
)
def glossary_clean(v: Views):
    clean = _raw_description(v).select("doc_id", T.clean_description(F.col("description")).alias("c"))
    return clean.select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("clean"), F.md5(T.tex_escape(F.col("c"))).alias("tex"))


def glossary_of(v: Views):
    """Communities as glossary names, document texts as their descriptions."""
    listed = v.vectors().select("id")
    seeded = v.clustering().where("cluster_id < 5").select("id")
    names = ops.merge_lists([listed, seeded])
    texts = v.documents.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("description")
    )
    extra = v.vectors().select("id", F.concat(F.lit("Subreddit no longer exists"), F.lit("")).alias("description"))
    described = ops.with_description(names, texts, extra)
    z = stats.z_scores(v.scores()).withColumn("score", F.col("z"))
    wide = z.groupBy("id").pivot("dim", ops.GLOSSARY_DIMENSIONS).agg(F.max("score"))
    bins = wide.select("id", *[truncate_clamp(F.col(d)).alias(d) for d in ops.GLOSSARY_DIMENSIONS])
    return ops.glossary_lines(described, bins)


def _tag(dim: str) -> str:
    return f"'{{gstd_{dim}_' || replace(CAST(max(CASE WHEN dim = '{dim}' THEN CAST(greatest(-3, least(3, trunc(z))) AS INTEGER) END) AS VARCHAR), '-', 'n') || '}}'"


_SHORT = (
    "CASE WHEN d IN ('Subreddit no longer exists') THEN '\\textit{Community banned or deleted prior to publication}' ELSE "
    + _tex_sql("d")
    + " END"
)
_FIRST_LINE = r"""CASE WHEN length(rtrim(w)) <= 130 THEN rtrim(w) ELSE regexp_extract(w, '^(.{0,129}\S)\s', 1) END"""
_CLEAN_TEXT = _CLEAN.replace("'# [r/x_' || doc_id || '](http://a.b/c) *b* 漢{50%} ' || text", "text")
_LINES = f"""
    SELECT n.first_letter, n.position, n.id, '\\glossarytitle{{' || replace(n.id, '_', '\\_') || '}}' || t.tags
           || ' \\newline \\glossarydesc{{' || ({_SHORT}) || '}}' || CASE WHEN n.position % 2 = 1 THEN '&' ELSE '\\\\' END AS line
    FROM (SELECT id, upper(substr(id, 1, 1)) AS first_letter,
                 row_number() OVER (PARTITION BY upper(substr(id, 1, 1)) ORDER BY lower(id), id) - 1 AS position FROM vectors_v) n
    JOIN (SELECT id, {_tag('age')} || {_tag('gender')} || {_tag('partisan')} AS tags FROM z_v GROUP BY id) t ON t.id = n.id
    JOIN (SELECT id, CASE WHEN c IS NULL THEN 'Subreddit no longer exists' WHEN {_FIRST_LINE} <> c THEN {_FIRST_LINE} || '...' ELSE c END AS d
          FROM (SELECT v.id, c, regexp_replace(c, '\\s', ' ', 'g') AS w FROM vectors_v v
                LEFT JOIN (SELECT 's' || doc_id AS id, {_CLEAN_TEXT} AS c FROM documents) x ON x.id = v.id)) d
      ON d.id = n.id"""


@query("glossary_lines", _LINES)
def glossary_lines(v: Views):
    return glossary_of(v)


@query(
    "glossary_sections",
    f"""
    SELECT first_letter, position, line || CASE WHEN position = n - 1 AND n % 2 = 0 THEN '\\\\' ELSE '' END AS line
    FROM (SELECT *, count(*) OVER (PARTITION BY first_letter) AS n FROM ({_LINES}))
    UNION ALL SELECT DISTINCT upper(substr(id, 1, 1)), -1, '\\glossaryheader{{' || upper(substr(id, 1, 1)) || '}} &' FROM vectors_v""",
)
def glossary_sections(v: Views):
    return ops.glossary_sections(glossary_of(v))


@query(
    "glossary_names",
    """
    SELECT id, CASE WHEN upper(substr(id, 1, 1)) BETWEEN 'A' AND 'Z' THEN upper(substr(id, 1, 1)) ELSE '0-9' END AS first_letter,
           row_number() OVER (PARTITION BY upper(substr(id, 1, 1)) ORDER BY lower(id), id) - 1 AS position
    FROM (SELECT id FROM vectors_v UNION SELECT word FROM words_scored_v WHERE regexp_full_match(word, '[a-z]+'))""",
)
def glossary_names(v: Views):
    words = v.words_scored().where(T.is_latin(F.col("word"))).select(F.col("word").alias("id"))
    names = ops.merge_lists([v.vectors().select("id"), words]).withColumn("key", F.lower("id"))
    return with_position(names, ["key", "id"], ["first_letter"]).drop("key")


@query(
    "redacted_words",
    """
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(w, 'n.gger', 'n-gger', 'g'), 'f.ggot', 'f-ggot', 'g'), 'r.tard', 'r-tard', 'g') AS word
    FROM (SELECT p_partkey, p_brand || ' n' || p_size % 10 || 'gger f' || p_partkey % 10 || 'ggots r' || p_partkey % 12 || 'tard' AS w FROM part)""",
)
def redacted_words(v: Views):
    """Words that the patterns match, with another character in place of the vowel; two digits are no match."""
    word = F.concat(
        "p_brand", F.lit(" n"), F.col("p_size") % 10, F.lit("gger f"), F.col("p_partkey") % 10, F.lit("ggots r"), F.col("p_partkey") % 12, F.lit("tard")
    )
    return v.part.select("p_partkey", T.redact(word).alias("word"))
