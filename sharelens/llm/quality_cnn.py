"""Quality: a byte-level convolutional network in numpy.

Every byte of a document has a small learned embedding, to which two channels are added that say whether
the bytes around it stood at the same distance before (so repeated words and lines are visible to
local filters). Learned filters slide over the bytes; the strongest response of each filter in each
chunk is kept, chunks overlap by half and cover the whole document; their maxima are combined, as mean
and maximum over the chunks, into one probability. Gradients flow through the maxima to the few
positions that made them, so training is cheap. The trained arrays travel to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import class_counts, fold, labelled_sample, learnable, per_batch

FOLDS, HELD = 5, 0
EMBED, EXTRA, WIDTH, STRIDE, FILTERS = 6, 1, 8, 2, 24
HALF = 128  # bytes of half a chunk


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here on also start at the last place with the same bytes up to 255 bytes before."""
    n = len(data)
    if n < 5:
        return np.zeros(n, np.float32)
    wide = data.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    near = order[1:] - order[:-1] < 256
    out = np.zeros(n, np.float32)
    out[order[1:][same & near]] = 1
    return out


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes of a text (a multiple of half a chunk, two halves at least, and one window's overhang) and the extra channel."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = max(2, -(-len(data) // HALF)) * HALF + WIDTH - STRIDE
    padded = np.zeros(size, np.uint8)
    padded[: len(data)] = data
    extra = np.zeros((size, EXTRA), np.float32)
    extra[: len(data), 0] = repeats(data)
    return padded, extra


class Network:
    """Embedding, filters, and a logistic layer over mean and maximum of the chunks' strongest responses."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        channels = EMBED + EXTRA
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * channels) ** -0.5, (WIDTH * channels, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.odds = np.float32(0)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def responses(self, data: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Filter responses at every stride: (halves, positions in a half, filters)."""
        channels = EMBED + EXTRA
        x = np.concatenate((self.embed[data], extra), axis=1)
        n = (len(data) - (WIDTH - STRIDE)) // STRIDE
        view = np.lib.stride_tricks.as_strided(
            x, (n, WIDTH * channels), (STRIDE * channels * 4, 4), writeable=False
        )
        return (view @ self.filters).reshape(-1, HALF // STRIDE, FILTERS)

    def pooled(self, data: np.ndarray, extra: np.ndarray, block: int = 256) -> np.ndarray:
        """Strongest response of each filter in each half, computed a block of halves at a time."""
        halves = (len(data) - (WIDTH - STRIDE)) // HALF
        out = np.empty((halves, FILTERS), np.float32)
        for at in range(0, halves, block):
            to = min(at + block, halves)
            piece = slice(at * HALF, to * HALF + WIDTH - STRIDE)
            out[at:to] = self.responses(data[piece], extra[piece]).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def features(self, half: np.ndarray) -> np.ndarray:
        chunk = np.maximum(half[:-1], half[1:])
        return np.concatenate((chunk.mean(axis=0), chunk.max(axis=0)))

    def score(self, text: str) -> float:
        """Probability of label 1 for a whole text."""
        logit = self.features(self.pooled(*windows_of(text))) @ self.out + self.shift[0] + self.odds
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def gradients(self, data: np.ndarray, extra: np.ndarray, label: int) -> list[np.ndarray]:
        """Gradients of the logistic loss of one text."""
        channels = EMBED + EXTRA
        raw = self.responses(data, extra)
        at = raw.argmax(axis=1)
        half = np.maximum(np.take_along_axis(raw, at[:, None, :], 1)[:, 0] + self.bias, 0)
        chunk = np.maximum(half[:-1], half[1:])
        feature = np.concatenate((chunk.mean(axis=0), chunk.max(axis=0)))
        slope = 1 / (1 + np.exp(-np.clip(feature @ self.out + self.shift[0], -30, 30))) - label
        to_chunk = np.repeat(slope * self.out[None, :FILTERS] / len(chunk), len(chunk), axis=0)
        to_chunk[chunk.argmax(axis=0), np.arange(FILTERS)] += slope * self.out[FILTERS:]
        left = half[:-1] >= half[1:]
        to_half = np.zeros_like(half)
        to_half[:-1] += to_chunk * left
        to_half[1:] += to_chunk * ~left
        to_half *= half > 0
        start = (np.arange(len(half))[:, None] * HALF + at * STRIDE)[:, :, None] + np.arange(WIDTH)
        window = np.concatenate((self.embed[data[start]], extra[start]), axis=3).reshape(len(half), FILTERS, -1)
        to_filters = np.einsum("hf,hfk->kf", to_half, window)
        to_window = (to_half[:, :, None] * self.filters.T[None]).reshape(len(half), FILTERS, WIDTH, channels)[..., :EMBED]
        to_embed = np.zeros_like(self.embed)
        np.add.at(to_embed, data[start].ravel(), to_window.reshape(-1, EMBED))
        return [to_embed, to_filters, to_half.sum(axis=0), slope * feature, np.array([slope], np.float32)]

    def fit(self, examples: list[tuple[tuple[np.ndarray, np.ndarray], int]], epochs: int, rate: float = 0.01, batch: int = 16) -> None:
        """Adam over shuffled minibatches."""
        first = [np.zeros_like(a) for a in self.arrays()]
        second = [np.zeros_like(a) for a in self.arrays()]
        step = 0
        total = epochs * -(-len(examples) // batch)
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(examples))
            for at in range(0, len(order), batch):
                part = [examples[i] for i in order[at : at + batch]]
                sums = [sum(g) / len(part) for g in zip(*(self.gradients(*x, y) for x, y in part), strict=True)]
                step += 1
                pace = rate * (1 - step / (total + 1))
                for a, g, m, v in zip(self.arrays(), sums, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def spread(text: Column, most: int, pieces: int = 16) -> Column:
    """A text of more than ``most`` bytes as ``pieces`` even pieces of it, first and last included, ``most`` code points in all at most."""
    size = most // pieces
    step = F.greatest(F.char_length(text) - size, F.lit(0)) / (pieces - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.array_join(cut, "\n"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, most_bytes: int = 1 << 14, epochs: int = 6) -> Network | float:
    """Learns from at most ``per_class`` texts of each label; a constant where one label is missing.

    A text of the sample longer than ``most_bytes`` teaches through sixteen pieces spread evenly over the whole of it, of as many code
    points together, so the sample is bounded in bytes too; scoring reads every text whole. The odds of all labels
    correct the balanced sample.
    """
    known = learnable(labels, "quality", FOLDS, HELD)
    counts = class_counts(known)
    odds = (counts[1] + 0.5) / (counts[0] + 0.5)
    sample = labelled_sample(docs, known, counts, per_class).select(spread(F.col("text"), most_bytes).alias("text"), "label")
    rows = sorted((r["text"], int(r["label"])) for r in sample.collect())
    ones = sum(label for _, label in rows)
    if not 0 < ones < len(rows):
        return odds / (1 + odds)
    network = Network()
    network.fit([(windows_of(text), label) for text, label in rows], epochs)
    network.odds = np.float32(np.log(odds) - np.log(ones / (len(rows) - ones)))
    return network


def score(docs: DataFrame, model: Network | float, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts are scored as two halves of padding. held_out is false for a row without an id.
    Repeated rows score alike; an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        if isinstance(model, float):
            scores = [model] * batch.num_rows
        else:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())}

    scored = per_batch(docs.select("doc_id", F.col("text").cast("string")), f"doc_id {kind}, score double", work, 4 << 20)
    held = fold(F.col("doc_id"), FOLDS) == HELD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
