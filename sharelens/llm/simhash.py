"""SimHash near-duplicates, found by bit-sliced comparison inside pigeonhole blocks.

Every two fingerprints that differ in at most three of 64 bits agree on three of six bit groups. For
each of the 20 choices of three groups the distinct fingerprints are sorted by those (about 32) bits,
and every run of equal bits is compared completely: bit planes are stored vertically, one word holds
one bit of 64 fingerprints, carry-save counters add up differing planes for all of them at once, and
a block is abandoned as soon as every counter is beyond the radius. Of the links inside a run only a
spanning forest is emitted, so a large group of near copies costs rows in proportion to its size.
Exact copies share a fingerprint and are compared once. Components are closed by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.llm.common import packed, per_batch, unpacked
from sharelens.session import settle

BITS, SEED, RADIUS, SHINGLE = 64, 42, 3, 3
#: Sizes of the bit groups; any RADIUS bits leave at least three groups untouched.
GROUPS = (11, 11, 11, 11, 10, 10)
#: Runs up to this size are compared many at a time, longer ones block by block.
SMALL_RUN = 64
#: Runs beyond this size are cut into blocks of it, and every two blocks are a task's group of their own.
LONG_RUN = 1 << 14


def bit_planes(values: np.ndarray) -> np.ndarray:
    """uint64 values -> 64 rows, row k holding bit k of all values, packed 64 to a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def within(planes: Iterator[np.ndarray], radius: int = RADIUS) -> np.ndarray | None:
    """Words of flags telling which slots differ in at most ``radius`` of the planes; None if none does.

    ``planes`` yields words of differing bits. Counters of as many bits as ``radius`` needs start so
    that they overflow exactly beyond it; every eight planes the block is abandoned if all have.
    """
    width = radius.bit_length()
    counter: list[np.ndarray] = []
    over = None
    for k, carry in enumerate(planes):
        if over is None:
            start = (1 << width) - 1 - radius
            ones = np.full_like(carry, ~np.uint64(0))
            counter = [ones.copy() if start >> i & 1 else np.zeros_like(carry) for i in range(width)]
            over = np.zeros_like(carry)
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if k % 8 == 7 and over.min() == ~np.uint64(0):
            return None
    return None if over is None else ~over


def flags_of(words: np.ndarray, n: int) -> np.ndarray:
    """Packed flags as n booleans along the last axis."""
    as_bytes = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(as_bytes, axis=-1, bitorder="little")[..., :n].astype(bool)


def fingerprint(counts: np.ndarray, n: int) -> int:
    """Bits set in more than half of n hashes, as an unsigned integer."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the 3-word shingles, repeats included; of the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def bit_counts(hashes: np.ndarray, piece: int = 4096) -> np.ndarray:
    """How many hashes set each of the 64 bits."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), piece):
        part = hashes[at : at + piece].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the fingerprint as a signed long, and further columns as they are; null and empty texts have zero."""

    def work(batch: pa.RecordBatch) -> dict:
        prints = []
        for text in batch.column("text"):
            hashes = shingle_hashes(text.as_py())
            prints.append(fingerprint(bit_counts(hashes), len(hashes)))
        kept = {name: batch.column(name) for name in more}
        return {"doc_id": batch.column("doc_id"), "fp": np.array(prints, np.uint64).view(np.int64)} | kept

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["doc_id " + kinds["doc_id"], "fp bigint", *(f"{name} {kinds[name]}" for name in more)])
    return per_batch(docs.select("doc_id", F.col("text").cast("string").alias("text"), *more), schema, work)


def masks() -> list[int]:
    """For each choice of three bit groups the bits they cover."""
    edges = np.cumsum((0, *GROUPS)).tolist()
    group = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(group, len(GROUPS) - RADIUS)]


def forest(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Joins components along links: ``label`` names the smallest node of each node's component, before and after."""
    while True:
        a, b = label[left], label[right]
        low, after = np.minimum(a, b), label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        while (after != after[after]).any():
            after = after[after]
        if (after == label).all():
            return label
        label = after


def links_in(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values that have a link inside their run of equal keys, each with the root of its part of the run."""
    n = len(values)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, n))
    size_of = np.repeat(sizes, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    index = np.arange(n)
    end_of = np.repeat(starts + sizes, sizes)
    for shift in range(1, min(int(sizes.max(initial=0)), SMALL_RUN)):
        left = index[(size_of <= SMALL_RUN) & (index + shift < end_of)]
        for at in range(0, len(left), 1 << 16):
            part = left[at : at + (1 << 16)]
            flags = within(iter(bit_planes(values[part] ^ values[part + shift])))
            if flags is not None:
                hit = part[flags_of(flags, len(part))]
                found.append((hit, hit + shift))
    for start, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist(), strict=True):
        found += block_links(values, start, size)
    left = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    right = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
    nodes, places = np.unique(np.concatenate((left, right)), return_inverse=True)
    label = forest(np.arange(len(nodes)), places[: len(left)], places[len(left) :])
    return values[nodes], values[nodes[label]]


def block_links(values: np.ndarray, start: int, size: int, queries: int = 64, block: int = 1 << 15, asking: int = 0) -> list:
    """Spanning links of one long run: groups of queries against blocks of vertical bit planes.

    With ``asking`` only the run's first so many values are compared with the others, none among themselves.

    Labels are kept while going, and a link inside one label is dropped at once, so what is held and
    returned is in proportion to the run, not to its links.
    """
    run = values[start : start + size]
    label = np.arange(size)
    out = []
    every = ~np.uint64(0)
    for low in range(asking, size, block):
        planes = bit_planes(run[low : low + block])
        width = min(block, size - low)
        for first in range(0 if asking else low, asking or size, queries):
            group = run[first : min(first + queries, asking or size)]
            asked = [np.where(group >> np.uint64(k) & np.uint64(1), every, np.uint64(0))[:, None] for k in range(BITS)]
            flags = within(planes[k][None, :] ^ asked[k] for k in range(BITS))
            if flags is None:
                continue
            a, b = np.nonzero(flags_of(flags, width))
            a, b = a + first, b + low
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if len(a):
                label = forest(label, a, b)
    tied = np.flatnonzero(label != np.arange(size))
    if len(tied):
        out.append((tied + start, label[tied] + start))
    return out


def near_pairs(prints: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Distinct ``fp`` values -> links (a, b): every linked value with the root of its part of each run.

    A task holds at most ``long_run`` values of a run. Those of a longer run are handed on in numbered blocks (``t``, the key as ``b``) and
    compared block by block.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("k")) for t, m in enumerate(masks())))
    dealt = prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    ordered = dealt.repartition("t", "k").sortWithinPartitions("t", "k")
    names = ["a", "b", "t", "block"]

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        apart = a != b
        a, b = a[apart].view(np.int64), b[apart].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        handed = 0  # blocks of the open run that were handed on

        def ready(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.concatenate(([0], np.cumsum((block[1:, :2] != block[:-1, :2]).any(axis=1))))
            yield linked(*links_in(change, np.ascontiguousarray(block[:, 2]).view(np.uint64)))

        def hand_on(block: np.ndarray, number: int) -> pa.RecordBatch:
            n = len(block)
            columns = [block[:, 2], block[:, 1], block[:, 0].astype(np.int32), np.full(n, number, np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, handed
            if held:
                block = np.concatenate(held)
                if handed:
                    yield hand_on(block, handed)
                else:
                    yield from ready(block)
            held, handed = [], 0

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield from close()
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            cut = int(np.argmax(last))  # rows are sorted: the open run is the tail
            if cut:
                if handed:  # the long run ends in this batch
                    end = int(np.argmax((rows[:, :2] != rows[0, :2]).any(axis=1)))
                    held.append(rows[:end])
                    yield from close()
                    rows, cut = rows[end:], cut - end
                if cut:
                    yield from ready(np.concatenate((*held, rows[:cut])))
                    held = []
                rows = rows[cut:]
            held.append(rows)
            while sum(map(len, held)) > long_run:
                block = np.concatenate(held)
                yield hand_on(block[:long_run], handed)
                held, handed = [block[long_run:]], handed + 1
        yield from close()

    first = settle(ordered.mapInArrow(run, "a bigint, b bigint, t int, block int"))
    parts = first.where("t is not null").select("t", F.col("b").alias("k"), "block", F.col("a").alias("fp"))
    sizes = parts.groupBy(F.col("t").alias("_t"), F.col("k").alias("_k")).agg(F.max("block").alias("most"))
    joined = parts.join(sizes, (F.col("t") == F.col("_t")) & (F.col("k") == F.col("_k")))
    other = joined.select("t", "k", "block", "fp", F.explode(F.sequence(F.lit(0), "most")).alias("other"))
    pairs = other.select("t", "k", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    keys = ["t", "k", "low", "high", "block"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            values = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
            asking = int((rows[:, 4] == rows[0, 2]).sum()) if rows[0, 2] != rows[0, 3] else 0
            for a, b in block_links(values, 0, len(values), asking=asking):
                yield linked(values[a], values[b]).select(["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            edges = [0, *(np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1).tolist(), len(rows)]
            for low, high in zip(edges, edges[1:], strict=False):
                if held and (held[-1][-1, :4] != rows[low, :4]).any():
                    yield from done()
                    held = []
                held.append(rows[low:high])
        if held:
            yield from done()

    long = pairs.repartition(*keys[:4]).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(compare, "a bigint, b bigint")
    return first.where("t is null").select("a", "b").union(long).distinct()


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root) for every node but the roots; root is the smallest node of the component.

    Alternates large stars (every larger neighbour joins the smallest) and small stars (every smaller
    one does) until nothing changes; minima are pre-aggregated, hubs are left to skew-join splitting.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = settle(links.select(high.alias("a"), low.alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = settle(large)
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))
        now = settle(small.where("a <> b").distinct())
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        after = tuple(now.agg(F.count(F.lit(1)), total).first())
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after


def components(docs: DataFrame, *more: str) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id, the smallest id reachable over links.

    Null and empty texts share fingerprint zero and are linked like any other. A null id takes part in
    links; it is a component's id only if the component has no other. Repeated rows give repeated
    rows. An empty table gives an empty result. Other columns than those named in ``more`` are ignored.
    """
    prints = settle(fingerprints(docs, *more))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = contract(near_pairs(distinct.select("fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(rooted.join(smallest, "root").select(F.col("fp").alias("print"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id", *more)


def hex_of(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id.

    Rows that repeat an id and a text are one document. Rows without an id are kept where the group has
    no id at all, one per text.
    """
    found = components(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), "mark")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept"), F.col("mark").alias("what")).distinct()
    each = packed(docs, "doc_id", F.xxhash64("text").alias("mark"))
    chosen = each.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("mark") == F.col("what")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.lit(0)))
    return unpacked(chosen.withColumn("turn", turn).where("turn = 1"), docs.columns)
