"""Language identification with string kernels.

The kernel of two texts counts the 1- to 3-grams that occur in both (blended spectrum, presence only),
divided by the geometric mean of their numbers of distinct n-grams. Nyström landmarks, some texts of
each language, turn it into a finite map; kernel ridge regression, one language against the rest, is
solved in that map. Scoring a batch is a matrix product per language, presence of the n-grams of its landmarks times
the landmarks' presence, and one of all kernel values with the projected weights. Each language keeps the n-grams of its
own landmarks only, so a model grows in proportion to its landmarks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharelens.llm.common import fold, per_batch, text_of

FOLDS, HELD = 4, 2
#: n-grams are over 128 symbols: space, letters a to z, digits, punctuation, the 33 letters from U+00DF, the rest by code point.
SYMBOLS, ORDERS = 128, (1, 2, 3)
CODES = sum(SYMBOLS**n for n in ORDERS)


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, 28, np.uint8)
    codes = np.arange(0x110000)
    table[0x100:] = 62 + codes[0x100:] % 66
    table[[9, 10, 11, 12, 13, 32, 0xA0]] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    table[0xDF:0x100] = np.arange(29, 62)
    return table


class Grams:
    """Distinct n-grams of texts; keeps its tables between calls."""

    def __init__(self):
        self.symbols = _symbol_table()
        self.last = np.zeros(CODES, np.int32)

    def of(self, text: str) -> np.ndarray:
        """Codes of the distinct n-grams of a whole text, white space runs counted as one space."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[points].astype(np.int32)
        s = np.concatenate(([0], s, [0]))
        s = s[~((s == 0) & (np.concatenate(([1], s[:-1])) == 0))]
        parts, base, code = [], 0, np.zeros(len(s), np.int32)
        for n in ORDERS:
            if len(s) < n:
                break
            code = code[: len(s) - n + 1] * SYMBOLS + s[n - 1 :]
            parts.append(code + base)
            base += SYMBOLS**n
        codes = np.concatenate(parts)
        place = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = place
        return codes[self.last[codes] == place]


class Model:
    """Landmarks over their own vocabulary, and one column of weights per language."""

    def __init__(self, languages: list[str], examples: list[np.ndarray], labels: np.ndarray, landmarks: np.ndarray, ridge: float):
        self.languages = languages
        self._grams = None
        if not languages:
            return
        chosen = [examples[i] for i in landmarks]
        self.sizes = np.array([max(1, len(c)) for c in chosen], np.float32)
        # one block a language: (its first landmark, sorted n-grams, presence of each in its landmarks)
        self.blocks: list[tuple[int, np.ndarray, np.ndarray]] = []
        of = labels[landmarks]
        for first in np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist():
            own = [chosen[i] for i in range(first, len(chosen)) if of[i] == of[first]]
            vocabulary = np.unique(np.concatenate(own))
            presence = np.zeros((len(vocabulary), len(own)), np.uint8)
            for column, codes in enumerate(own):
                presence[np.searchsorted(vocabulary, codes), column] = 1
            self.blocks.append((first, vocabulary, presence))
        among = self.kernel(chosen).astype(np.float64)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        keep = values > 1e-6 * values.max()
        project = vectors[:, keep] / np.sqrt(values[keep])
        mapped = self.kernel(examples).astype(np.float64) @ project
        goal = (labels[:, None] == np.arange(len(languages))).astype(np.float64)
        solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ goal)
        self.weights = project @ solved

    def __getstate__(self):
        return self.__dict__ | {"_grams": None}

    def kernel(self, texts: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """Kernel values of texts, given as distinct codes, with every landmark."""
        out = np.empty((len(texts), len(self.sizes)), np.float32)
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            sizes = np.array([len(c) for c in part])
            codes, rows = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
            for first, vocabulary, presence in self.blocks:
                place = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
                held = vocabulary[place] == codes
                found = np.zeros((len(part), len(vocabulary)), np.float32)
                found[rows[held], place[held]] = 1
                out[at : at + len(part), first : first + presence.shape[1]] = found @ presence.astype(np.float32)
            out[at : at + len(part)] /= np.sqrt(np.maximum(sizes, 1).astype(np.float32)[:, None] * self.sizes)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
        judged = [i for i, t in enumerate(texts) if self.languages and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not judged:
            return names, scores
        if self._grams is None:
            self._grams = Grams()
        raw = self.kernel([self._grams.of(texts[i]) for i in judged]).astype(np.float64) @ self.weights
        raw = np.maximum(raw, 0).round(9)
        best = raw.argmax(axis=1)
        share = raw.max(axis=1) / np.maximum(raw.sum(axis=1), 1e-9)
        for k, i in enumerate(judged):
            names[i], scores[i] = self.languages[best[k]], min(1.0, round(float(share[k]), 6))
        return names, scores


def train(docs: DataFrame, per_language: int = 400, landmarks: int = 32, languages: int = 200, ridge: float = 0.05) -> Model:
    """Learns from at most ``per_language`` texts of each of the most frequent ``languages``.

    Texts with the smallest id hashes are taken, with text and lang given, outside the held-out fold;
    of each language the first ``landmarks`` become landmarks. A threshold on the hash, a little above what a language's count asks for,
    comes before the ranking, which so sees about as many rows as it keeps. Only the n-gram codes of the sample reach the driver, as arrays.
    A language beyond the ``languages`` most frequent ones is never predicted.
    """
    known = docs.select("doc_id", F.col("lang").cast("string"), "text")
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), FOLDS).isin(HELD, -1))
    names = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select(F.col("lang").alias("of"), "count")
    ranked = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("mark"))
    ranked = ranked.join(F.broadcast(names), F.col("lang") == F.col("of"))
    ranked = ranked.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * F.col("count") <= 1.2 * per_language + 50)
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h", "mark")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "rank").dropDuplicates(["_id", "_mark"])
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    sample = known.join(F.broadcast(chosen), same).select("lang", "rank", text_of().alias("text"))
    grams: list[Grams] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not grams:
            grams.append(Grams())
        codes = [grams[0].of(t.as_py()) for t in batch.column("text")]
        return {"lang": batch.column("lang"), "rank": batch.column("rank"), "codes": pa.array(codes, pa.list_(pa.int32()))}

    rows = per_batch(sample, "lang string, rank int, codes array<int>", work).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")]).combine_chunks()
    names_of = rows["lang"].to_pylist()
    found = sorted(set(names_of))
    codes = rows["codes"].chunk(0) if rows.num_rows else []
    examples = [codes[i].values.to_numpy() for i in range(rows.num_rows)]
    labels = np.array([found.index(name) for name in names_of], np.int64)
    first = [i for k in range(len(found)) for i in np.flatnonzero(labels == k)[:landmarks].tolist()]
    return Model(found, examples, labels, np.array(first, np.int64), ridge)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    The whole text is read; nothing else is. Null texts and texts without a letter are ``und`` with score 0,
    and so is everything if there was nothing to learn from. held_out is false for a row without an id.
    Repeated rows are judged alike; an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        names, scores = model.predict([t or "" for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    schema = f"doc_id {kind}, lang_pred string, score double"
    judged = per_batch(docs.select("doc_id", F.col("text").cast("string")), schema, work, 4 << 20)
    return judged.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
