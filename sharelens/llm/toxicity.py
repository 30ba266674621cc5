"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours, and pairs with one word between, hashed
into a fixed number of slots. Learning uses per-coordinate rates and an L1 penalty, which leaves most
slots at exactly zero; the others travel to the tasks as index and weight arrays. Hashing is done for
a whole batch of texts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import class_counts, fold, labelled_sample, learnable, per_batch

SLOTS = 1 << 20
FOLDS, HELD = 5, 0
#: Bytes of words: ASCII letters (lower case by then) and digits, everything beyond ASCII.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]).translate(_TABLE), np.uint8)
    inside = data != 0x20
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.flatnonzero(before & ~inside) - starts
    place = (np.flatnonzero(inside) - np.repeat(starts, lengths)).astype(np.uint64)
    worth = _mixed(data[inside].astype(np.uint64) + (place + np.uint64(1)) * _STEP)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.add.reduceat(worth, firsts), np.searchsorted(np.cumsum(sizes), starts, side="right")


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and text numbers; a slot may occur repeatedly in a text."""
    words, owner = word_hashes(texts)
    slots, owners = [_mixed(words)], [owner]
    for gap, salt in ((1, 0x51), (2, 0xA3)):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = _mixed(words[:-gap] * np.uint64(3) + words[gap:] * _STEP + np.uint64(salt))
            slots.append(pair[same])
            owners.append(owner[gap:][same])
    return (np.concatenate(slots) % np.uint64(SLOTS)).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal: per-coordinate learning rates, L1 and L2 penalties."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, free)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, SLOTS)  # the last coordinate is the intercept
        w = self.weights(at)
        slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + slope * slope) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += slope - rate * w
        self.n[at] += slope * slope


class Model:
    """Sparse weights: sorted slots, their weights, and the intercept."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, intercept: float):
        self.slots, self.weights, self.intercept = slots, weights, intercept
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(SLOTS, np.float32)
            self._table[self.slots] = self.weights
        slots, owner = slots_of(texts)
        heavy = self._table[slots] != 0
        each = np.unique(owner[heavy] * SLOTS + slots[heavy])
        total = np.bincount(each // SLOTS, self._table[each % SLOTS], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -35, 35)))


def collect_examples(sample: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Slots and label of every sampled text, in an order that does not depend on partitioning."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        slots, owner = slots_of(texts)
        each = np.unique(owner * SLOTS + slots)
        edges = np.searchsorted(each, np.arange(len(texts) + 1) * SLOTS)
        found = (each % SLOTS).astype(np.int32)
        return {
            "slots": pa.array([found[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.list_(pa.int32())),
            "label": batch.column("label").cast(pa.int32()),
            "mark": batch.column("mark"),
        }

    marked = sample.withColumn("mark", F.xxhash64("text"))
    rows = per_batch(marked, "slots array<int>, label int, mark bigint", work, piece_bytes=1 << 20).toArrow()
    order = np.lexsort((rows["label"].to_numpy(), rows["mark"].to_numpy()))
    labels, slots = rows["label"].to_numpy(), rows["slots"].combine_chunks()
    flat, edges = slots.flatten().to_numpy(), slots.offsets.to_numpy()
    flat, edges = flat, edges - edges[0]
    return [(flat[edges[i] : edges[i + 1]], int(labels[i])) for i in order.tolist()]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, epochs: int = 8) -> Model:
    """Learns from at most ``per_class`` texts of each label; the intercept is moved to the odds of all labels.

    A slot that only one text fills can teach nothing and takes no part.
    Without a label of either kind the model scores every text with the smoothed share of label 1.
    """
    known = learnable(labels, "toxic", FOLDS, HELD)
    counts = class_counts(known)
    odds = (counts[1] + 0.5) / (counts[0] + 0.5)
    examples = collect_examples(labelled_sample(docs, known, counts, per_class))
    ones = sum(label for _, label in examples)
    if not 0 < ones < len(examples):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(odds)))
    seen = np.bincount(np.concatenate([slots for slots, _ in examples]), minlength=SLOTS)
    examples = [(slots[seen[slots] > 1], label) for slots, label in examples]
    learner = Ftrl()
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            learner.learn(*examples[i])
    weights = learner.weights(np.arange(SLOTS + 1))
    used = np.flatnonzero(weights[:SLOTS])
    moved = np.log(odds) - np.log((ones + 0.5) / (len(examples) - ones + 0.5))
    return Model(used, weights[used].astype(np.float32), float(weights[SLOTS] + moved))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts get the score of no feature. held_out is false for a row without an id. Repeated
    rows score alike; an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        scores = model.scores([t or "" for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "score": scores}

    scored = per_batch(docs.select("doc_id", F.col("text").cast("string")), f"doc_id {kind}, score double", work, 1 << 20)
    held = fold(F.col("doc_id"), FOLDS) == HELD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
