"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

A line's key (stripped, A-Z lower-cased) is known by a 128-bit digest. One aggregation over the distinct keys of every text finds
those that stand in several documents. Their digests are dealt into shards of bounded size; a shard is a minimal perfect hash
(level after level, a key that is alone at its place gets that place's bit; a key's index is the rank of its bit) over compact arrays:
fingerprint, count, first document. The keys of the documents are streamed past the shards: in each task the arrays of a
shard come first and its probes follow, so no lines are joined or sorted by key. A shard that holds very common lines is
copied to as many tasks as its lines ask for. What a probe finds is listed per text and taken out of it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import packed, per_batch, small, unpacked
from sharelens.session import settle

#: White space at the ends of a line that its key leaves out.
BLANKS = b" \t\n\x0b\x0c\r"
LEAST_CHARS = 10
#: Most keys of a shard (about 2.5 MB of arrays).
SHARD_KEYS = 100_000
SHARD_BITS = 20


# ---------------------------------------------------------------- keys


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def counts_as_line(key: bytes) -> bool:
    """Whether a key has at least ``LEAST_CHARS`` code points."""
    size = len(key)
    return size >= 4 * LEAST_CHARS or size >= LEAST_CHARS and len(key.decode("utf-8", "surrogatepass")) >= LEAST_CHARS


def digests(text: bytes) -> list[bytes]:
    """Digests of the distinct keys of a text that are long enough."""
    keys = {key_of(line) for line in text.split(b"\n")}
    return [xxhash.xxh3_128_digest(k) for k in keys if counts_as_line(k)]


def as_pairs(found: list[bytes]) -> np.ndarray:
    """Digests as two signed 64-bit columns."""
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text's hash), a, b: the distinct keys of every row's text, as digests."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [digests(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        pairs = as_pairs([d for f in found for d in f])
        return {
            "doc_id": batch.column("doc_id").take(rows),
            "mark": batch.column("mark").take(rows),
            "a": np.ascontiguousarray(pairs[:, 0]),
            "b": np.ascontiguousarray(pairs[:, 1]),
        }

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return per_batch(source, "doc_id bigint, mark bigint, a bigint, b bigint", work)


# ---------------------------------------------------------------- minimal perfect hash


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys, another one for each level (multiply and shift, wrapping)."""
    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct uint64 keys -> 0..n-1, about three bits a key.

    Keys that find no place of their own in ``levels`` rounds are kept in a sorted list behind the others.
    """

    def __init__(self, words: list[np.ndarray], ranks: list[np.ndarray], rest: np.ndarray):
        self.words, self.ranks, self.rest = words, ranks, rest

    @classmethod
    def over(cls, keys: np.ndarray, room: float = 2.0, levels: int = 24) -> PerfectHash:
        words, ranks, base = [], [], 0
        for level in range(levels):
            if not len(keys):
                break
            size = 64 * max(1, int(np.ceil(room * len(keys) / 64)))
            place = mixed(keys, level) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            word = np.packbits(alone, bitorder="little").view("<u8")
            set_bits = np.bitwise_count(word).astype(np.int64)
            words.append(word)
            ranks.append(base + np.cumsum(set_bits) - set_bits)
            base += int(set_bits.sum())
            keys = keys[~alone[place.astype(np.int64)]]
        return cls(words, ranks, np.sort(keys))

    def __len__(self) -> int:
        return sum(int(np.bitwise_count(w).sum()) for w in self.words) + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a key that was not built in, any index or -1."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (word, rank) in enumerate(zip(self.words, self.ranks, strict=True)):
            place = mixed(keys[todo], level) % np.uint64(64 * len(word))
            at, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            held = word[at]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[todo[hit]] = (rank[at] + below)[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            found[todo[hit]] = len(self) - len(self.rest) + at[hit]
        return found


class Shard:
    """Arrays over the keys of one shard, behind their perfect hash: fingerprint, count and first document.

    The hash sees the first half of a digest, the fingerprint is the second. Keys that share their first half with an earlier
    one (one pair in about 10^13 keys) stand in ``twins`` and are looked up one by one.
    """

    def __init__(self, hashed: PerfectHash, check: np.ndarray, count: np.ndarray, first: np.ndarray, twins: np.ndarray):
        self.hashed, self.check, self.count, self.first, self.twins = hashed, check, count, first, twins

    @classmethod
    def over(cls, a: np.ndarray, b: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        keys, at = np.unique(a, return_index=True)
        hashed = PerfectHash.over(keys.view(np.uint64))
        slot = hashed.index(keys.view(np.uint64))
        arrays = [np.zeros(len(keys), np.int64) for _ in range(3)]
        for array, values in zip(arrays, (b, count, first), strict=True):
            array[slot] = values[at]
        other = np.setdiff1d(np.arange(len(a)), at)
        return cls(hashed, *arrays, np.stack([a[other], b[other], count[other], first[other]], axis=1))

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and first document per key; count 0 for a key that is not in the shard."""
        slot = self.hashed.index(a.view(np.uint64))
        known = slot >= 0
        known[known] = self.check[slot[known]] == b[known]
        count, first = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        count[known], first[known] = self.count[slot[known]], self.first[slot[known]]
        for twin_a, twin_b, n, doc in self.twins.tolist():
            same = (a == twin_a) & (b == twin_b)
            count[same], first[same] = n, doc
        return count, first

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = {f"w{i}": w for i, w in enumerate(self.hashed.words)} | {f"r{i}": r for i, r in enumerate(self.hashed.ranks)}
        np.savez(out, rest=self.hashed.rest, check=self.check, count=self.count, first=self.first, twins=self.twins, **levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        stored = np.load(io.BytesIO(data))
        depth = sum(name.startswith("w") for name in stored.files)
        hashed = PerfectHash([stored[f"w{i}"] for i in range(depth)], [stored[f"r{i}"] for i in range(depth)], stored["rest"])
        return cls(hashed, stored["check"], stored["count"], stored["first"], stored["twins"])


# ---------------------------------------------------------------- Spark


def in_several(keys: DataFrame) -> DataFrame:
    """a, b, n (rows), first (smallest document): the keys found in at least two documents.

    All rows without an id count as one more document, after those with an id.
    """
    grouped = keys.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.bool_or(F.col("doc_id").isNull()).alias("nameless"),
    )
    return grouped.where("first <> last or (nameless and first is not null)").select("a", "b", "n", "first")


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``names`` cut anew, so that each table holds one group."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            now = tuple(values[low].tolist())
            if held and now != group:
                yield pa.Table.from_batches(held)
                held = []
            group = now
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def shard_of(shards: int):
    """The shard of a key: its first half's low bits, independent of the bits that its perfect hash mixes."""
    return F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int")


def build(repeated: DataFrame, shards: int) -> DataFrame:
    """shard, lines (of its keys), arrays: one row for every shard that has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            a, b, n, first = (table[c].to_numpy() for c in ("a", "b", "n", "first"))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                    "lines": pa.array([int(n.sum())], pa.int64()),
                    "arrays": pa.array([Shard.over(a, b, n, first).to_bytes()], pa.binary()),
                }
            )

    dealt = repeated.withColumn("shard", shard_of(shards)).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, lines bigint, arrays binary")


def probe(keys: DataFrame, index: DataFrame, shards: int, n_keys: int, tasks: int) -> DataFrame:
    """doc_id, mark, a, b, n: the keys of documents that stand in several documents, of which this is not the first.

    A task reads the arrays of a shard and then streams its probes. A shard whose lines exceed a task's share
    is dealt over several tasks by the documents' marks, its arrays to each of them.
    """
    share = max(1, n_keys // tasks)
    parts = settle(index.select("shard", (1 + F.floor(F.col("lines") / share)).cast("int").alias("parts"), "arrays"))
    hot = small(settle(parts.where("parts > 1").select(F.col("shard").alias("_s"), F.col("parts").alias("_p"))), 100_000)
    asked = keys.withColumn("shard", shard_of(shards)).join(hot, F.col("shard") == F.col("_s"), "left")
    part = F.pmod(F.xxhash64("doc_id", "mark", F.lit(7)), F.coalesce("_p", F.lit(1))).cast("int")
    probes = asked.select("shard", part.alias("part"), F.lit(1).alias("turn"), "doc_id", "mark", "a", "b", F.lit(None).cast("binary").alias("arrays"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "mark", "a", "b")]
    served = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), *none, "arrays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("shard", "part")], axis=1)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                piece = batch.slice(low, high - low)
                if tuple(where[low]) != at:
                    at, shard = tuple(where[low]), None
                if piece.column("turn")[0].as_py() == 0:
                    shard = Shard.from_bytes(piece.column("arrays")[0].as_py())
                    piece = piece.slice(1)
                if shard is None or not piece.num_rows:  # a shard without keys has no arrays
                    continue
                count, first = shard.probe(piece.column("a").to_numpy(), piece.column("b").to_numpy())
                ids = piece.column("doc_id")
                own = ids.is_valid().to_numpy(zero_copy_only=False) & (ids.fill_null(0).to_numpy() == first)
                out = pa.array(np.flatnonzero((count > 0) & ~own))
                if len(out):
                    columns = [piece.column(c).take(out) for c in ("doc_id", "mark", "a", "b")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(count).take(out)], ["doc_id", "mark", "a", "b", "n"])

    dealt = probes.unionByName(served).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "turn")
    return dealt.mapInArrow(run, "doc_id bigint, mark bigint, a bigint, b bigint, n bigint")


def repeated_lines(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc, mark, gone (digests to take out, 16 bytes each), most (rows that hold the most common of them), one row per text that loses lines."""
    keys = settle(line_keys(docs))
    repeated = settle(in_several(keys))
    n_keys, n_repeated = keys.count(), repeated.count()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys // 4_000_000)
    shards = max(tasks, -(-2 * n_repeated // shard_keys))
    found = probe(keys, build(repeated, shards), shards, n_keys, tasks)
    # the group is the lines of one text; repeated rows list a key once more each
    return found.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("what")).agg(
        F.collect_set(F.struct("a", "b")).alias("gone"), F.max("n").alias("most")
    )


def joined(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns next to text, gone and most. Texts are dealt by id and hash."""
    text = F.col("text").cast("string")
    lists = repeated_lines(docs)
    side = docs.select(*names, F.col("doc_id").cast("bigint").alias("_d"), F.xxhash64(text).alias("_m"), text.alias("text"))
    return side.join(lists, F.col("_d").eqNullSafe(F.col("of")) & (F.col("_m") == F.col("what")), "left").select(*names, "text", "gone", "most")


def without_lines(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``name`` as it is, and text (what is kept), n_lines, n_dropped, most_copies."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        gone = batch.column("gone")
        offsets = gone.offsets.to_numpy()
        pairs = np.stack([gone.values.field(c).to_numpy() for c in ("a", "b")], axis=1).astype("<i8")
        kept, lines, dropped = [], [], []
        for i, text in enumerate(texts):
            parts = (text or b"").split(b"\n")
            low, high = offsets[i], offsets[i + 1]
            lines.append(len(parts))
            if high > low:
                out = {row.tobytes() for row in pairs[low:high]}
                parts = [p for p in parts if not (counts_as_line(k := key_of(p)) and xxhash.xxh3_128_digest(k) in out)]
            dropped.append(lines[-1] - len(parts))
            kept.append(b"\n".join(parts))
        return {
            name: batch.column(name),
            "text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(lines, pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64()),
            "most_copies": batch.column("most").fill_null(0),
        }

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    source = df.select(name, "text", F.coalesce("gone", none).alias("gone"), "most")
    return per_batch(source, f"`{name}` {kind}, text string, n_lines bigint, n_dropped bigint, most_copies bigint", work)


def drop_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text (what is kept), n_lines (before), n_dropped, most_copies (rows that hold its most common dropped line).

    A key of at least ten code points in two or more documents stays only in the smallest doc_id that holds it, there with all its lines.
    Null and empty texts are one empty line. Rows with one id are one document: they keep or lose a line together. Rows without an
    id are one more document, after all others. An empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return without_lines(joined(docs.select("doc_id", "text"), "doc_id"), "doc_id", kind)


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from their texts, same columns; a null text stays null, ``n_chars`` follows a changed text."""
    side = packed(docs, "doc_id", "text")
    done = without_lines(joined(side, "doc"), "doc", side.schema["doc"].dataType.simpleString()).withColumnRenamed("text", "left")
    hit = F.col("n_dropped") > 0
    changed = {
        "text": lambda old: F.when(hit, F.col("left")).otherwise(old),
        "n_chars": lambda old: F.when(hit, F.char_length("left").cast("bigint")).otherwise(old),
    }
    return unpacked(done, docs.columns, changed)


def lines_sql() -> str:
    """The query's rows in DuckDB's SQL."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {blanks}), '{upper}', '{lower}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first, count(*) AS n FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= {LEAST_CHARS})
  GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 2),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone, s.n FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
  coalesce(max(n) FILTER (gone), 0) AS most_copies
FROM j GROUP BY r, doc_id"""
