"""Rule-based document quality: base counts, then distribution divergence from language references.

All DataFrame functions. A document's histograms over character classes and over common words are
compared with the reference histograms of each language by Jensen-Shannon distance (base 2, so from
0 to 1); the nearest language counts. References are measured on the corpus itself: all documents of
a language that pass the base rules. Short documents are not judged by a histogram they cannot fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import SPACE, packed, text_of, unpacked, words_of
from sharelens.session import scratch_path, settle

#: Frequent function words of each language with a reference.
COMMON_WORDS = {
    "de": ("der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "ein", "auf"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "with", "as"),
    "es": ("el", "los", "que", "y", "del", "las", "por", "con", "una", "su", "para", "se"),
    "fr": ("le", "les", "et", "des", "du", "une", "dans", "pour", "qui", "sur", "est", "avec"),
}
#: Character classes counted by what a pattern leaves over (lower and upper case
#: letters, digits, symbols, punctuation); white space and all other characters are two more.
CLASSES = (r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^0-9]+", r"[^#*$%&|<>]+", r"[^!\x22'()+,./:;=?@\x5B-\x60\x7B}~-]+")
#: Thresholds on the distances and the lengths from which a histogram is trusted. A histogram of n characters strays
#: from its reference by chance, so the class threshold is raised by ALLOWANCE / sqrt(n).
MAX_CLASS_DISTANCE, ALLOWANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS = 0.15, 2.0, 0.5, 200, 50

VOCABULARY = tuple(w for lang in sorted(COMMON_WORDS) for w in COMMON_WORDS[lang])
#: One character per common word, so that a document's common words fit one string.
LETTERS = "".join(chr(0x100 + i) for i in range(len(VOCABULARY)))


def _left_over(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _repeated(places: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words that start at the given ascending places."""
    spans = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
    return F.aggregate(spans, F.lit(0), lambda total, n: total + n)


def measure(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with the base counts and the two histograms; columns of these names are replaced.

    A window is known by the 64-bit hash of its words. Equal windows are found by sorting the hashes of
    one document, and only where a hash occurs twice at all.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - width),
        lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(width))),
    )
    ordered = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.filter(
        "_sorted",
        lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"]),
    )
    index = F.array(*map(F.lit, VOCABULARY))
    common = F.transform(
        F.filter("_words", lambda w: F.lower(w).isin(*VOCABULARY)),
        lambda w: F.substring(F.lit(LETTERS), F.array_position(index, F.lower(w)).cast("int"), F.lit(1)),
    )
    known = F.array(*(F.char_length("_common") - F.char_length(F.replace("_common", F.lit(c))) for c in LETTERS))
    known_classes = F.array(*(_left_over(text, p) for p in CLASSES), (F.char_length(text) - F.col("word_chars")).cast("int"))
    others = F.char_length(text) - F.aggregate("_classes", F.lit(0), lambda total, n: total + n)
    return (
        docs.withColumn("_words", words_of(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"))
        .withColumn("n_symbols", _left_over(text, CLASSES[3]).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("_hashes", F.when(F.col("n_words") >= width, hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_twins", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
        .withColumn("_sorted", F.when(F.col("_twins"), ordered))
        .withColumn("_places", F.sort_array(F.transform(twins, lambda x: x["i"])))
        .withColumn("n_repeat_words", F.coalesce(_repeated(F.col("_places"), width), F.lit(0)).cast("long"))
        .withColumn("_common", F.array_join(common, ""))
        .withColumn("_classes", known_classes)
        .withColumn("class_counts", F.concat("_classes", F.array(others)))
        .withColumn("word_counts", F.concat(known, F.array(F.col("n_words").cast("int") - F.char_length("_common"))))
        .withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
        .drop("_words", "_hashes", "_twins", "_sorted", "_places", "_common", "_classes")
    )


def pooled(measured: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """One row per language: shares of character classes and common words over its documents that pass the base rules."""
    n_classes, n_words = len(CLASSES) + 2, len(VOCABULARY) + 1
    sums = [F.sum(F.get("class_counts", F.lit(i))).cast("double").alias(f"c{i}") for i in range(n_classes)]
    sums += [F.sum(F.get("word_counts", F.lit(i))).cast("double").alias(f"w{i}") for i in range(n_words)]
    classes = F.array(*(f"c{i}" for i in range(n_classes)))
    words = F.array(*(f"w{i}" for i in range(n_words)))
    totals = measured.where(F.col("lang").isin(*languages) & ~F.col("base_failed")).groupBy("lang").agg(*sums)
    return totals.select("lang", shares(classes).alias("classes"), shares(words).alias("words"))


def references(measured: DataFrame, languages: tuple[str, ...] = tuple(sorted(COMMON_WORDS))) -> DataFrame:
    """One row per language: its shares over the documents that are typical of it.

    Junk shifts a plain pool. So the pool of all documents only serves to find those that lie no
    farther from it, in character classes, than the language's documents do on average; the
    references are pooled over these. At most one row per language of ``languages``.
    """
    first = settle(pooled(measured, languages)).select(F.col("lang").alias("of"), "classes")
    rated = measured.join(F.broadcast(first), F.col("lang") == F.col("of"))
    rated = rated.withColumn("far", distance(shares(F.col("class_counts")), F.col("classes"))).drop("classes")
    usual = settle(rated.where(~F.col("base_failed")).groupBy("of").agg(F.avg("far").alias("usual")))
    typical = rated.join(F.broadcast(usual.withColumnRenamed("of", "of2")), F.col("of") == F.col("of2"))
    return pooled(typical.where(F.col("far") <= F.col("usual")).drop("of", "of2", "far", "usual"), languages)


def shares(counts: Column) -> Column:
    """Counts as shares of their sum."""
    total = F.aggregate(counts, F.lit(0.0), lambda t, c: t + c)
    return F.transform(counts, lambda c: F.try_divide(c.cast("double"), total))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays."""

    def term(a: Column, b: Column) -> Column:
        half = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.greatest(F.lit(0.0), total))


def judge(measured: DataFrame, known: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance (null without a reference) and kept; drops the histograms.

    ``known`` has at most one row per configured language and enters as one array.
    """
    table = known.agg(F.collect_list(F.struct("lang", "classes", "words"))).scalar()
    strange = F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON_WORDS)
    near = lambda of, part: F.array_min(F.transform("_refs", lambda r: distance(F.col(of), r[part])))
    limit = MAX_CLASS_DISTANCE + F.lit(ALLOWANCE) / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    far = (F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > limit)
    odd = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return (
        measured.withColumn("_refs", table)
        .withColumn("_p", shares(F.col("class_counts")))
        .withColumn("_q", shares(F.col("word_counts")))
        .withColumn("class_distance", near("_p", "classes"))
        .withColumn("word_distance", near("_q", "words"))
        .withColumn("kept", ~F.col("base_failed") & (strange | ~F.coalesce(far | odd, F.lit(False))))
        .drop("_refs", "_p", "_q", "class_counts", "word_counts")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, the base counts, base_failed, both distances and kept.

    The texts are read once; what is kept of them between the passes is counts. Null and empty texts
    have no words and fail the base rules. A document in a language that has no reference is judged
    by the base rules only, one without a language by the nearest reference. Without any reference
    (an empty corpus, or none that passes) the base rules decide. Repeated rows are judged alike.
    Other columns are ignored.
    """
    measured = settle(
        measure(docs.select("doc_id", F.col("lang").cast("string"), "text"))
        .withColumn("n_chars", F.char_length(text_of()))
        .drop("text")
    )
    return judge(measured, settle(references(measured)))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without those that the rules reject, same columns; measured texts pass through a table in the shared folder."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "quality-rules")
    measured = measure(packed(docs, "text", F.col("lang").cast("string").alias("lang")))
    measured.withColumn("n_chars", F.char_length(text_of())).drop("text").write.parquet(path)
    stored = spark.read.parquet(path)
    return unpacked(judge(stored, settle(references(stored))).where("kept"), docs.columns)


def rules_sql() -> str:
    """The query's rows in DuckDB's SQL."""
    vocabulary = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
    left_over = lambda p: f"length(regexp_replace(text, '{p}', '', 'g'))"
    classes = ", ".join(left_over(p.replace("'", "''")) for p in CLASSES)
    shares_of = lambda c: f"list_transform({c}, lambda x: x / list_sum({c}))"
    term = "coalesce(CASE WHEN p[i] > 0 THEN p[i] * log2(p[i] / ((p[i] + q[i]) / 2)) END, 0) / 2 + coalesce(CASE WHEN q[i] > 0 THEN q[i] * log2(q[i] / ((p[i] + q[i]) / 2)) END, 0) / 2"
    sums = lambda c, n: "[" + ", ".join(f"CAST(sum({c}[{i + 1}]) AS DOUBLE)" for i in range(n)) + "]"
    own = lambda doc, ref: f"sqrt(greatest(0.0, (SELECT sum({term.replace('p[', doc + '[').replace('q[', ref + '[')}) FROM range(1, len({doc}) + 1) t(i))))"
    near = lambda doc, ref: f"(SELECT min({own(doc, ref)}) FROM shares_ref)"
    langs = ", ".join(f"'{x}'" for x in sorted(COMMON_WORDS))
    return f"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS w FROM worded, unnest(range(1, greatest(len(words) - 3, 1))) t(i)),
twins AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
spans AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM twins),
repeats AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM spans GROUP BY 1),
counted AS (
  SELECT doc_id, lang, length(text) AS n_chars, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST({left_over(CLASSES[3])} AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    [{classes}, length(text) - length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))] AS some_classes,
    list_append(some_classes, n_chars - list_sum(some_classes)) AS classes,
    list_transform({vocabulary}, lambda v: len(list_filter(words, lambda w: lower(w) = v))) AS hits
  FROM worded LEFT JOIN repeats r USING (doc_id)),
measured AS (SELECT * EXCLUDE (hits), list_append(hits, n_words - list_sum(hits)) AS hits,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
pool AS (SELECT lang AS of, {sums("classes", len(CLASSES) + 2)} AS c FROM measured WHERE lang IN ({langs}) AND NOT base_failed GROUP BY lang),
pool_shares AS (SELECT of, {shares_of("c")} AS rc FROM pool),
rated AS (SELECT m.*, {own("dc", "rc")} AS far FROM (SELECT *, {shares_of("classes")} AS dc FROM measured WHERE NOT base_failed) m JOIN pool_shares ON lang = of),
usual AS (SELECT lang AS of, avg(far) AS usual FROM rated GROUP BY lang),
refs AS (SELECT lang, {sums("classes", len(CLASSES) + 2)} AS c, {sums("hits", len(VOCABULARY) + 1)} AS w
  FROM rated JOIN usual ON lang = of WHERE far <= usual GROUP BY lang),
shares_ref AS (SELECT {shares_of("c")} AS rc, {shares_of("w")} AS rw FROM refs),
shares_doc AS (SELECT *, {shares_of("classes")} AS dc, {shares_of("hits")} AS dw FROM measured),
judged AS (SELECT *, {near("dc", "rc")} AS class_distance, {near("dw", "rw")} AS word_distance FROM shares_doc)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ((lang IS NOT NULL AND lang NOT IN ({langs}))
    OR NOT coalesce((n_chars >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE} + {ALLOWANCE} / sqrt(greatest(n_chars, 1))) OR (n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE}), false)) AS kept
FROM judged"""
