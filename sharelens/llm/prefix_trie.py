"""The trie of all beginnings of conversations, measured by the Euler-tour technique.

Nodes are the distinct sequences of first turns, known by depth and a 128-bit hash of the sequence and named by their smallest member
and depth. Every node has an enter and an exit arc; the tour goes down to the first child, on to the next sibling, back up to the
parent. Links come from one scan over nodes and their children in a global order, so a node with very many children is no group.
The tour is list-ranked: arcs of one member's stretch lie together and are joined to segments within tasks; then, round by
round, segments whose hash is smaller than both neighbours' leave the list, which shrinks by a third each time, until a bounded
rest is walked; the rounds are undone in reverse. What is added up is one for the arc, its leaf and its saving, so an arc's rank
comes with the prefix sums at its position, and a subtree's leaves and savings are the difference between exit and enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.operators.positions import with_position
from sharelens.operators.scan import ordered_scan
from sharelens.session import collect_bounded, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Arcs of one stretch that are joined within a task, and segments of the list that are walked in one go.
STRETCH, REST = 2048, 4096
WEIGHTS = ("w0", "w1", "w2")
ARC = "conv bigint, k bigint"


# ---------------------------------------------------------------- turns


def digested(conversations: DataFrame) -> DataFrame:
    """conv, turn, what (digest of role and text), words; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    what = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", what.alias("what"), words.alias("words"))


def runs(values: np.ndarray, last, counted: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each row's run of equal values, and its 1-based place in it; ``counted`` rows of ``last`` came before."""
    change = np.concatenate(([True], values[1:] != values[:-1]))
    starts = np.maximum.accumulate(np.where(change, np.arange(len(values)), 0))
    place = np.arange(len(values)) - starts + 1
    if values[0] == last:
        place[starts == 0] += counted
    return starts, place


def carried(merge):
    """For ``ordered_scan``: summaries (first key, last key, state of the last key's rows) joined over partitions of one key."""

    def combine(carry, value):
        first, last, state = value
        return (first, last, merge(carry[2], state)) if carry and carry[1] == last == first else value

    return combine


def numbered(turns: DataFrame, order: list[str], name: str) -> DataFrame:
    """``turns`` with column ``name``, the place in their conversation from 1; they lie in the order of conv and ``order``."""
    columns = turns.columns

    def summarise(batches):
        first = last = n = None
        for batch in batches:
            _, place = runs(batch.column("conv").to_numpy(), last, n)
            first = batch.column("conv")[0].as_py() if first is None else first
            last, n = batch.column("conv")[-1].as_py(), int(place[-1])
        return first, last, n

    def run(batches, before, after):
        _, last, n = before or (None, None, 0)
        for batch in batches:
            _, place = runs(batch.column("conv").to_numpy(), last, n)
            last, n = batch.column("conv")[-1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(place)], [*columns, name])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema), f"{name} bigint"])
    return ordered_scan(turns, ["conv", *order], summarise, carried(lambda a, b: a + b), run, schema)


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, part, pos, what, words; ordered by part, pos) and all conversations (conv).

    Conversation c begins with the first h turns of conversation c - c % 20 and goes on with its own after its first h, h being
    crc32 of c in decimal modulo 4.
    """
    shared = lambda c: F.crc32(F.col(c).cast("string")) % 4
    convs = placed.where("pos = 1").select("conv")
    heads = placed.where("conv % 20 = 0 and pos <= 3").select(F.col("conv").alias("base"), "pos", "what", "words")
    asking = convs.select("conv", (F.col("conv") - F.col("conv") % 20).alias("of"), shared("conv").alias("h")).where("h > 0")
    first = asking.join(heads, (F.col("of") == F.col("base")) & (F.col("pos") <= F.col("h")))
    own = placed.where(F.col("pos") > shared("conv"))
    columns = ["pos", "what", "words"]
    return first.select("conv", F.lit(0).alias("part"), *columns).union(own.select("conv", F.lit(1).alias("part"), *columns)), convs


# ---------------------------------------------------------------- nodes


def mixed(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A hash of a turn's hash at a depth (wrapping multiplications)."""
    x = x + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def beginnings(turns: DataFrame, order: list[str]) -> DataFrame:
    """One row per turn: conv, depth, x1, x2 (its sequence from the start), p1, p2 (the same without it), words, final.

    A sequence's hash is the exclusive or of its turns' hashes, each mixed with its depth, so it runs along a conversation.
    """
    zero = (np.uint64(0), np.uint64(0))

    def along(batch, last, state):
        conv, depth = batch.column("conv").to_numpy(), batch.column("depth").to_numpy()
        starts, _ = runs(conv, None, 0)
        sums, before = [], []
        for half, carry in zip(("g1", "g2"), state, strict=True):
            h = mixed(batch.column(half).to_numpy().view(np.uint64), depth)
            total = np.bitwise_xor.accumulate(h)
            base = np.where(starts > 0, total[starts - 1], np.uint64(0))
            if conv[0] == last:
                base[starts == 0] ^= carry
            sums.append(total ^ base)
            before.append(total ^ base ^ h)
        return conv, depth, sums, before

    def summarise(batches):
        first = last = None
        state = zero
        for batch in batches:
            conv, _, sums, _ = along(batch, last, state)
            first = int(conv[0]) if first is None else first
            last, state = int(conv[-1]), tuple(s[-1] for s in sums)
        return first, last, state

    def rows(columns, final):
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(final)], ["conv", "depth", "x1", "x2", "p1", "p2", "words", "final"])

    def run(batches, before, after):
        _, last, state = before or (None, None, zero)
        waiting = None  # whether a turn is its conversation's last is known from the row behind it
        for batch in batches:
            conv, depth, sums, old = along(batch, last, state)
            last, state = int(conv[-1]), tuple(s[-1] for s in sums)
            columns = [conv, depth, *(c.view(np.int64) for c in (*sums, *old)), batch.column("words").to_numpy()]
            if waiting is not None:
                columns = [np.concatenate((w, c)) for w, c in zip(waiting, columns, strict=True)]
            waiting = [c[-1:] for c in columns]
            yield rows([c[:-1] for c in columns], columns[0][1:] != columns[0][:-1])
        if waiting is not None:
            yield rows(waiting, np.array([after is None or after[0] != waiting[0][0]]))

    source = numbered(turns.select("conv", *order, F.xxhash64("what").alias("g1"), F.xxhash64("what", F.lit(1)).alias("g2"), "words"), order, "depth")
    merge = carried(lambda a, b: tuple(x ^ y for x, y in zip(a, b, strict=True)))
    schema = "conv bigint, depth bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, words bigint, final boolean"
    return ordered_scan(source.select("conv", "depth", "g1", "g2", "words"), None, summarise, merge, run, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """x1, x2, ends_sha256: the digest of each node's ids (conv), ascending, in decimal, comma-joined.

    Ids are sorted over ranges, so those of one node spread over tasks, which join them to pieces of text; a node's pieces are then
    streamed through one digest in their order. Memory stays at one piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, conv = (batch.column(c).to_numpy() for c in ("x1", "x2", "conv"))
            edges = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
            texts = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(edges, edges[1:], strict=False)]
            starts = edges[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(texts)], ["x1", "x2", "at", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["x1", "x2", "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], ["x1", "x2", "ends_sha256"])

    keys = ["x1", "x2", "conv"]
    joined = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "x1 bigint, x2 bigint, at bigint, ids string")
    return joined.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "at").mapInArrow(digest, "x1 bigint, x2 bigint, ends_sha256 string")


# ---------------------------------------------------------------- the tour


def tour_arcs(nodes: DataFrame) -> DataFrame:
    """The tour's arcs but the root's exit, and one row with the number of children of every node that has any.

    An arc is (conv, k): the node's name and twice its depth, plus one for the exit; (to_conv, to_k) follows it. Enter arcs carry
    n_convs, x1, x2 and the weights leaf and saved, exit arcs parent_conv. Rows with n_children have no follower.

    Nodes and, under their parent's hash, children by conv lie in one order: behind a node comes its first child, behind a child
    its next sibling, and the node before is the parent.
    """
    own = nodes.select(F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.lit(0).alias("child"), "conv", "depth", "n_convs", "words")
    under = nodes.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("child"), "conv", "depth", F.lit(None).cast("bigint").alias("n_convs"), F.lit(None).cast("bigint").alias("words"))
    names = ["child", "conv", "depth", "n_convs", "words", "k1", "k2"]

    def columns_of(batch):
        return [batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in names]

    def parents(child, conv, carry):
        """Each row's node (itself or its parent) and its place among the children; ``carry`` is (node, place) of the row before."""
        at = np.maximum.accumulate(np.where(child == 0, np.arange(len(child)), -1))
        place = np.where(at >= 0, np.arange(len(child)) - at, np.arange(len(child)) + 1 + carry[1])
        return np.where(at >= 0, conv[np.maximum(at, 0)], carry[0]), place

    def summarise(batches):
        first, state, all_children = None, (None, 0), True
        for batch in batches:
            child, conv, *_ = columns_of(batch)
            first = (int(child[0]), int(conv[0])) if first is None else first
            all_children = all_children and bool(child.all())
            node, place = parents(child, conv, (state[0] or 0, state[1]))
            state = (int(node[-1]) if not all_children else None, int(place[-1]))
        return first, state

    def combine(carry, value):
        node, place = value[1]
        return value if node is not None or carry is None else (value[0], (carry[1][0], carry[1][1] + place))

    def run(batches, before, after):
        carry, waiting = (before[1] if before else (0, 0)), None
        for batch in batches:
            columns = columns_of(batch)
            node, place = parents(columns[0], columns[1], carry)
            carry = (int(node[-1]), int(place[-1]))
            columns += [node, place]
            if waiting is not None:
                columns = [np.concatenate((w, c)) for w, c in zip(waiting, columns, strict=True)]
            waiting = [c[-1:] for c in columns]
            yield from linked([c[:-1] for c in columns], columns[0][1:], columns[1][1:])
        if waiting is not None:
            follows = after[0] if after else (0, 0)
            yield from linked(waiting, np.array([follows[0]]), np.array([follows[1]]))

    def linked(columns, next_child, next_conv):
        child, conv, depth, n, words, k1, k2, node, place = columns
        if not len(child):
            return
        down, own_row = next_child == 1, child == 0
        k = 2 * depth + child
        to_conv = np.where(own_row, np.where(down, next_conv, conv), np.where(down, next_conv, node))
        to_k = np.where(own_row, np.where(down, k + 2, k + 1), np.where(down, k - 1, k - 2))
        leaf, none = own_row & ~down, np.zeros(len(child), np.int64)
        masked = lambda values, keep: pa.array(values, mask=~keep)
        names = ["conv", "k", "to_conv", "to_k", "leaf", "saved", "n_convs", "x1", "x2", "parent_conv", "n_children"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (conv, k, to_conv, to_k, leaf.astype(np.int64), np.where(own_row, (n - 1) * words, 0))]
            + [masked(c, own_row) for c in (n, k1, k2)]
            + [masked(node, ~own_row), masked(none, leaf)],
            names,
        )
        last = np.flatnonzero(~own_row & ~down)
        if len(last):
            gone = pa.nulls(len(last), pa.int64())
            zero = pa.array(np.zeros(len(last), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[last]), pa.array(2 * (depth[last] - 1)), gone, gone, zero, zero, gone, gone, gone, gone, pa.array(place[last])], names
            )

    schema = f"{ARC}, to_conv bigint, to_k bigint, leaf bigint, saved bigint, n_convs bigint, x1 bigint, x2 bigint, parent_conv bigint, n_children bigint"
    return ordered_scan(own.unionByName(under), ["k1", "k2", "child", "conv"], summarise, combine, run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``names`` cut anew, so that no group is parted."""
    held: list[pa.RecordBatch] = []  # rows of one group
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
        closed = int(np.argmax((values == values[-1]).all(axis=1)))  # rows before the batch's last group
        goes_on = held and [held[-1].column(n)[-1].as_py() for n in names] == values[-1].tolist()
        if not goes_on and (held or closed):
            yield pa.Table.from_batches([*held, batch.slice(0, closed)])
            held = []
        held.append(batch.slice(closed))
    if held:
        yield pa.Table.from_batches(held)


def stretches(arcs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The arcs with the head of their segment (head_conv, head_k), the sums from it up to them (w0, w1, w2: arcs, leaves, savings), and
    for a segment's last arc the sums over the segment (s0, s1, s2).

    Of one member at most ``stretch`` arcs are looked at together. Arc k + j of a member lies j rows behind its arc k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["conv", "block"]):
            conv, block, k = (table[c].to_numpy() for c in ("conv", "block", "k"))
            to_conv, to_k = (table[c].fill_null(-1).to_numpy() for c in ("to_conv", "to_k"))
            n = len(conv)
            follower = np.arange(n) + to_k - k
            inside = (follower >= 0) & (follower < n) & table["to_k"].is_valid().to_numpy()
            f = np.where(inside, follower, 0)
            inside &= (conv[f] == to_conv) & (k[f] == to_k) & (conv == to_conv) & (block[f] == block)
            weights = np.stack([np.ones(n, np.int64), table["leaf"].to_numpy(), table["saved"].to_numpy()], axis=1)
            head, sums = np.arange(n), np.zeros((n, 3), np.int64)
            head[f[inside]] = np.flatnonzero(inside)
            sums[f[inside]] = weights[inside]
            while (head[head] != head).any():
                sums, head = sums + sums[head], head[head]
            total = sums + weights
            end = ~inside
            out = table.select(["conv", "k", "to_conv", "to_k", "n_convs", "x1", "x2", "parent_conv", "n_children"])
            for name, values in (("head_conv", conv[head]), ("head_k", k[head]), *((w, sums[:, i]) for i, w in enumerate(WEIGHTS))):
                out = out.append_column(name, pa.array(values))
            for i in range(3):
                out = out.append_column(f"s{i}", pa.array(total[:, i], mask=~end))
            yield from out.combine_chunks().to_batches()

    kinds = "to_conv bigint, to_k bigint, n_convs bigint, x1 bigint, x2 bigint, parent_conv bigint, n_children bigint, head_conv bigint, head_k bigint"
    dealt = arcs.withColumn("block", F.floor(F.col("k") / stretch)).repartition("conv", "block").sortWithinPartitions("conv", "block", "k")
    return dealt.mapInArrow(run, f"{ARC}, {kinds}, w0 bigint, w1 bigint, w2 bigint, s0 bigint, s1 bigint, s2 bigint")


def list_ranks(segments: DataFrame, rest: int = REST) -> DataFrame:
    """id, w0, w1, w2: the weights of all segments before each one in the list (id, to, w0, w1, w2; ``to`` is null at the end).

    A round takes out every segment whose hash is smaller than those of both neighbours: the one before takes over its follower and
    weight. Those are about a third, never neighbours, and never an end. At most ``rest`` segments are walked on the driver; then the
    rounds are undone: a segment's sum is that of its follower at the time, less its own weight.
    """
    weights = [F.col(w) for w in WEIGHTS]
    none = F.lit(None).cast(segments.schema["id"].dataType)
    zeros = [F.lit(0).cast("bigint").alias(w) for w in WEIGHTS]
    merged = [F.max("to").alias("to"), F.max("prev").alias("prev"), *(F.sum(w).alias(w) for w in WEIGHTS)]
    before = segments.where("to is not null").select(F.col("to").alias("id"), none.alias("to"), F.col("id").alias("prev"), *zeros)
    now = settle(segments.select("id", "to", none.alias("prev"), *weights).union(before).groupBy("id").agg(*merged))
    steps: list[DataFrame] = []
    while now.count() > rest:
        of = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))), F.col(c))
        out = F.col("to").isNotNull() & F.col("prev").isNotNull() & (of("id") < of("to")) & (of("id") < of("prev"))
        gone = now.where(out)
        steps.append(gone.select(F.col("id").alias("left"), F.col("to").alias("behind"), *(F.col(w).alias(f"less{w}") for w in WEIGHTS)))
        told = gone.select(F.col("prev").alias("id"), "to", none.alias("prev"), F.lit(1).alias("news"), *weights).union(
            gone.select(F.col("to").alias("id"), none.alias("to"), "prev", F.lit(1).alias("news"), *zeros)
        )
        kept = now.where(~out).select("id", "to", "prev", F.lit(0).alias("news"), *weights)
        fresh = lambda c: F.coalesce(F.max(F.when(F.col("news") == 1, F.col(c))), F.max(F.when(F.col("news") == 0, F.col(c)))).alias(c)
        now = settle(kept.union(told).groupBy("id").agg(fresh("to"), fresh("prev"), *(F.sum(w).alias(w) for w in WEIGHTS)))
    found = {tuple(r["id"]): r for r in collect_bounded(now, rest, "segments")}
    row = next((r for r in found.values() if r["prev"] is None), None)
    sums, ranks = [0, 0, 0], []
    while row is not None:
        ranks.append((row["id"], *sums))
        sums = [a + row[w] for a, w in zip(sums, WEIGHTS, strict=True)]
        row = found[tuple(row["to"])] if row["to"] is not None else None
    kind = segments.schema["id"].dataType.simpleString()
    known = segments.sparkSession.createDataFrame(ranks, f"id {kind}, w0 bigint, w1 bigint, w2 bigint")
    for step in reversed(steps):
        undone = step.join(known, F.col("behind") == F.col("id"))
        known = settle(known.union(undone.select(F.col("left").alias("id"), *((F.col(w) - F.col(f"less{w}")).alias(w) for w in WEIGHTS))))
    return known


def prefix_trie(turns: DataFrame, conversations: DataFrame, order: list[str], stretch: int = STRETCH, rest: int = REST) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, the columns of ``order``, what, words); ``conversations`` (conv) may have no turns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes in its
    subtree, itself included), saved_tokens (over the subtree, words of a node's last turn for each member but one), ends_sha256
    (of the members that end here), enter, exit (positions of its arcs in the tour). No conversations: no rows.
    """
    spark = turns.sparkSession
    n, smallest = conversations.agg(F.count("conv"), F.min("conv")).first()
    path = settle(beginnings(turns, order))
    grouped = path.groupBy("depth", "x1", "x2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words")
    )
    columns = ["depth", "x1", "x2", "conv", "n_convs", "p1", "p2", "words"]
    top = [(0, 0, 0, smallest, n, None, None, 0)] if n else []
    root = spark.createDataFrame(top, ", ".join(f"{c} bigint" for c in columns))
    arcs = settle(tour_arcs(grouped.select(*columns).union(root)))
    exits = [F.lit(v).cast("bigint").alias(c) for c, v in zip(arcs.columns, [smallest, 1, None, None, 0, 0, None, None, None, None, None], strict=True)]
    last = root.select(*exits)  # the tour ends with the root's exit
    listed = settle(stretches(arcs.where("to_k is not null").union(last), stretch))
    pair = lambda a, b: F.struct(F.col(a).alias("conv"), F.col(b).alias("k"))
    segments = listed.where("s0 is not null").select(
        pair("head_conv", "head_k").alias("id"), F.when(F.col("to_k").isNotNull(), pair("to_conv", "to_k")).alias("to"), *(F.col(f"s{i}").alias(w) for i, w in enumerate(WEIGHTS))
    )
    ranks = list_ranks(segments, rest).select(F.col("id.conv").alias("_c"), F.col("id.k").alias("_k"), *(F.col(w).alias(f"_{w}") for w in WEIGHTS))
    at = listed.join(ranks, (F.col("head_conv") == F.col("_c")) & (F.col("head_k") == F.col("_k")))
    at = at.select("conv", "k", *((F.col(w) + F.col(f"_{w}")).alias(w) for w in WEIGHTS), "n_convs", "x1", "x2", "parent_conv", "n_children")
    counts = arcs.where("to_k is null").select("conv", "k", *(F.lit(None).cast("bigint").alias(w) for w in WEIGHTS), "n_convs", "x1", "x2", "parent_conv", "n_children")
    side = lambda w, s: F.max(F.when(F.col("k") % 2 == s, F.col(w)))
    nodes = at.union(counts).groupBy("conv", F.shiftright("k", 1).alias("depth")).agg(
        *(F.max(c).alias(c) for c in ("n_convs", "x1", "x2", "parent_conv", "n_children")),
        (side("w1", 1) - side("w1", 0)).alias("n_leaves"),
        (side("w2", 1) - side("w2", 0)).alias("saved_tokens"),
        side("w0", 0).alias("enter"),
        side("w0", 1).alias("exit"),
    )
    empty = conversations.join(path.where("depth = 1").select("conv"), "conv", "left_anti").select(F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"), "conv")
    ends = end_digests(path.where("final").select("x1", "x2", "conv").union(empty)).select(F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), "ends_sha256")
    named = nodes.join(ends, (F.col("x1") == F.col("_x1")) & (F.col("x2") == F.col("_x2")), "left")
    return named.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "enter",
        "exit",
    )


def conversation_trie(conversations: DataFrame, stretch: int = STRETCH, rest: int = REST) -> DataFrame:
    """The trie of rebuilt conversations, see :func:`rebuilt` and :func:`prefix_trie`.

    Turns are ordered by turn with nulls first; equal turns by the MD5 of role and text, so repeated rows are turns of their own. Null
    roles and texts are empty. Rows without conv_id take no part, other columns are ignored, an empty table gives no rows.
    """
    turns, convs = rebuilt(settle(numbered(digested(conversations), ["turn", "what"], "pos")))
    return prefix_trie(turns, convs, ["part", "pos"], stretch, rest)


def last_turns(nodes: DataFrame, turns: DataFrame, order: list[str | Column]) -> DataFrame:
    """``nodes`` (but the root) with role and text of their last turn, from the turns (conv_id, ``order``, role, text) of their smallest member."""
    placed = with_position(turns, order, ["conv_id"], "_pos")
    placed = placed.select(F.col("conv_id").alias("_conv"), (F.col("_pos") + 1).alias("_depth"), "role", "text")
    return nodes.join(placed, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("_depth"))).drop("_conv", "_depth")


def trie_sql() -> str:
    """The query's rows in DuckDB's SQL: every beginning is a list of turns, subtrees are found through members."""
    crc = (
        "xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ord(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    )
    return f"""
WITH t AS (SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY turn NULLS FIRST, md5(length(x.role) || ':' || x.role || x.text)) AS x FROM t GROUP BY c),
h AS (SELECT *, {crc} % 4 AS h FROM own),
r AS (SELECT h.c, list_concat(coalesce(b.x[1:h.h], []), h.x[h.h + 1:]) AS x FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
p AS (SELECT c, len(x) AS n, d, x[1:d] AS x FROM (SELECT *, unnest(range(len(x) + 1)) AS d FROM r)),
m AS (SELECT c, n, d, x, min(c) OVER (PARTITION BY d, x) AS o FROM p),
v AS (SELECT o, d, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(len(regexp_extract_all(x[d].text, '[^\x20\x09-\x0D]+'))) END AS words,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY o, d),
e AS (SELECT v.*, u.o AS parent FROM v LEFT JOIN m u ON u.c = v.o AND u.d = v.d - 1),
k AS (SELECT parent AS o, d - 1 AS d, count(*) AS n FROM e WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT u.o, u.d, sum((e.n_convs - 1) * e.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM e LEFT JOIN k ON k.o = e.o AND k.d = e.d JOIN m u ON u.c = e.o AND u.d <= e.d GROUP BY 1, 2)
SELECT e.o AS conv_id, e.d AS depth, e.parent AS parent_conv_id, e.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN s ON s.o = e.o AND s.d = e.d LEFT JOIN k ON k.o = e.o AND k.d = e.d"""
