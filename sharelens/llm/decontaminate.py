"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one pattern). The
search works on words instead of characters: it looks at the pair of words under its position, a
shift table tells how far no pattern can end, and where the shift is zero the pair's bucket holds the
patterns that end with it, which are compared word for word. Most texts are passed in steps of twelve
words. Items enter in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import packed, per_batch, small, text_of, unpacked
from sharelens.session import settle

WINDOW = 13
#: Bytes that belong to words: digits, lower-case letters and everything beyond ASCII; upper case is lowered.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WuManber:
    """Search for patterns of at least ``shortest`` words, all of them tuples of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], object]):
        self.shortest = min(map(len, patterns))
        self.block = min(2, self.shortest)
        self.far = self.shortest - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[int, dict[bytes, object]]] = {}
        for pattern, value in patterns.items():
            for end in range(self.block, self.shortest + 1):
                key = b" ".join(pattern[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), self.shortest - end)
            key = b" ".join(pattern[self.shortest - self.block : self.shortest])
            self.bucket.setdefault(key, {}).setdefault(len(pattern), {})[b" ".join(pattern)] = value

    def find(self, words: list[bytes]):
        """Yields (start, length, value) for every occurrence of every pattern."""
        at, n, m, pair = self.shortest, len(words), self.shortest, self.block == 2
        shift, far = self.shift, self.far
        while at <= n:
            key = words[at - 2] + b" " + words[at - 1] if pair else words[at - 1]
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - m
            for length, texts in self.bucket[key].items():
                value = texts.get(b" ".join(words[start : start + length])) if start + length <= n else None
                if value is not None:
                    yield start, length, value
            at += 1


def searchers(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    """One search for full windows, one for short items, so that these do not shorten its steps."""
    full: dict = {}
    short: dict = {}
    for name, words in items:
        if len(words) >= window:
            for i in range(len(words) - window + 1):
                full.setdefault(tuple(words[i : i + window]), set()).add(name)
        elif words:
            short.setdefault(tuple(words), set()).add(name)
    return [WuManber(p) for p in (full, short) if p]


def hits(text: str | None, search: list[WuManber]) -> tuple[int, list[int], set[str]]:
    """Number of words, places of hit words, names of the items found."""
    words = words_of(text)
    mark = None
    names: set[str] = set()
    for one in search:
        for start, length, found in one.find(words):
            if mark is None:
                mark = np.zeros(len(words), bool)
            mark[start : start + length] = True
            names |= found
    return len(words), [] if mark is None else np.flatnonzero(mark).tolist(), names


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """Yields lists of (name, words), each from about ``block_bytes`` of item text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), text_of().alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [(r["name"], words_of(r["text"])) for r in items.where(part == k).toLocalIterator()]


def search(docs: DataFrame, items: list[tuple[str, list[bytes]]]) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, places of hit words, names of items; one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    built: list = []

    def work(batch: pa.RecordBatch) -> dict:
        if not built:
            built.append(searchers(items))
        found = [hits(text.as_py(), built[0]) for text in batch.column("text")]
        return {
            "doc_id": batch.column("doc_id"),
            "mark": batch.column("mark"),
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "places": pa.array([p for _, p, _ in found], pa.list_(pa.int32())),
            "names": pa.array([sorted(s) for _, _, s in found], pa.list_(pa.string())),
        }

    asked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return per_batch(asked, f"doc_id {kind}, mark bigint, n_words bigint, places array<int>, names array<string>", work)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 2 << 20, share: int = 20) -> DataFrame:
    """One row per document: doc_id, mark (a hash of the text), n_words, n_hit, n_items, names, contaminated.

    A document is contaminated if hit words are at least one in ``share`` of its words. Null texts have
    no words; items without words match nothing; items without an id count as one named by the empty
    string; items that repeat an id are one item. An empty benchmark hits nothing. Repeated rows are
    judged alike. Further blocks of a large benchmark are searched in passes of their own; their
    hits, a small part of the documents, are joined by id and text hash.
    """
    found, more = None, None
    for items in item_blocks(benchmark, block_bytes):
        part = search(docs, items)
        if found is None:
            found = part
        else:
            part = settle(part.where(F.size("places") > 0).select("doc_id", "mark", "places", "names"))
            more = part if more is None else more.union(part)
    if more is not None:
        merged = more.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
            F.array_distinct(F.flatten(F.collect_set("places"))).alias("_places"),
            F.array_distinct(F.flatten(F.collect_set("names"))).alias("_names"),
        )
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
        both = lambda a, b: F.array_distinct(F.concat(a, F.coalesce(b, F.array().cast(dict(found.dtypes)[a]))))
        found = found.join(merged, same, "left").select(
            "doc_id", "mark", "n_words", both("places", "_places").alias("places"), both("names", "_names").alias("names")
        )
    n_hit = F.size("places").cast("long")
    return found.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("names").cast("long").alias("n_items"),
        F.array_sort("names").alias("names"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` without contaminated documents, same columns.

    Only the list of contaminated documents meets the texts again, by id and text hash.
    """
    found = contamination(docs, benchmark, block_bytes).where("contaminated")
    bad = small(settle(found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()), 1_000_000)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return unpacked(packed(docs, "doc_id", F.xxhash64("text").alias("mark")).join(bad, same, "left_anti"), docs.columns)


def digest_of(names: Column) -> Column:
    """Lower-case hex SHA-256 of sorted names, comma-joined."""
    return F.sha2(F.array_join(names, ","), 256)


def contamination_sql(share: int = 20) -> str:
    """The query's rows in DuckDB's SQL."""
    words = lambda text: f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH items AS (SELECT item_id, {words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i+{WINDOW - 1}], 'string_agg', ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
slices AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS win
  FROM docs, lengths, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM slices JOIN windows USING (win, n)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) t(p) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)"""
