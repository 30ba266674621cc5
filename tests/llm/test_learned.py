"""Held-out accuracy of the three learned operators, and checks of their parts."""

import zlib

import numpy as np
import pytest

from sharelens.llm import language, quality_cnn, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def auc(labels, scores):
    ranks = np.argsort(np.argsort(scores))
    ones = sum(labels)
    return (ranks[np.array(labels) == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def held_out(scored, marks, label):
    rows = [(r[label], r.score) for r in scored.where("held_out").join(marks, "doc_id").collect()]
    return [a for a, _ in rows], [b for _, b in rows]


def test_language_accuracy(docs):
    found = language.identify(docs, language.train(docs))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)


def test_distinct_grams_are_exact():
    grams, table = language.Grams(), language._symbol_table()
    for text in ("abab", "", "  A  b ", "ÄÖü ß", "x" * 5000):
        s = [0, *(int(table[ord(c)]) for c in text.lower()), 0]
        s = [c for i, c in enumerate(s) if not (i and c == 0 and s[i - 1] == 0)]
        want = {(n, tuple(s[i : i + n])) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
        assert len(grams.of(text)) == len(set(grams.of(text).tolist())) == len(want)


def test_kernel_is_shared_presence():
    grams = language.Grams()
    texts = [grams.of(t) for t in ("the cat sat", "the dog sat", "der hund sitzt", "die katze sitzt")]
    model = language.Model(["de", "en"], texts, np.array([1, 1, 0, 0]), np.array([0, 3]), 0.1)
    want = [[len(set(a.tolist()) & set(b.tolist())) / np.sqrt(len(a) * len(b)) for b in (texts[0], texts[3])] for a in texts]
    assert np.allclose(model.kernel(texts), want, atol=1e-6)


def test_undetermined(spark):
    docs = spark.createDataFrame([(1, "123 !!"), (2, None), (3, "")], "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    assert {(r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()} == {("und", 0.0)}


def test_quality_held_out(docs, marks):
    labels, scores = held_out(quality_cnn.score(docs, quality_cnn.train(docs, marks)), marks, "quality")
    assert auc(labels, scores) > 0.95


def test_network_gradients():
    network = quality_cnn.Network(3)
    data, extra = quality_cnn.windows_of("abc def abc def *** " * 30)
    loss = lambda: np.log1p(np.exp(-(network.features(network.pooled(data, extra)) @ network.out + network.shift[0])))
    for array, gradient in zip(network.arrays(), network.gradients(data, extra, 1), strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = array[at]
        step = 1e-2
        array[at] = kept + step
        up = loss()
        array[at] = kept - step
        down = loss()
        array[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(gradient[at], rel=0.1, abs=1e-3)


def test_chunks_cover_the_end_of_a_long_text():
    network = quality_cnn.Network()
    clean = "word " * 30_000
    assert network.score(clean) != network.score(clean[:-10] + "#*#*#*#*#*")


def test_toxicity_held_out(docs, marks):
    labels, scores = held_out(toxicity.score(docs, toxicity.train(docs, marks)), marks, "toxic")
    assert auc(labels, scores) > 0.85


def test_hashes_depend_on_words_only():
    one, owner = toxicity.word_hashes(["Ab, cd", "", "x ab\ncd"])
    other, _ = toxicity.word_hashes(["ab cd"])
    assert one.tolist()[:2] == other.tolist() == one.tolist()[3:] and owner.tolist() == [0, 0, 2, 2, 2]


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(0)
    learner = toxicity.Ftrl(l1=2.0)
    for _ in range(3000):
        slots = np.unique(rng.integers(1, 2000, 20))
        bad = rng.random() < 0.3
        learner.learn(np.append(slots, 5000) if bad else slots, int(bad))
    weights = learner.weights(np.arange(toxicity.SLOTS))
    assert weights.argmax() == 5000 and weights[5000] > 1 and np.count_nonzero(weights) < 500


def test_missing_labels_give_a_constant(spark, docs, marks):
    none = marks.where("false")
    assert {round(r.score, 6) for r in toxicity.score(docs.limit(5), toxicity.train(docs, none)).collect()} == {0.5}
    assert {round(r.score, 6) for r in quality_cnn.score(docs.limit(5), quality_cnn.train(docs, none)).collect()} == {0.5}


def test_long_texts_teach_through_pieces_of_the_whole(spark):
    from pyspark.sql import functions as F

    texts = ["short", "x" * 40_000 + "the end", "", "é" * 9000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", quality_cnn.spread(F.col("t"), 16_384).alias("s")).orderBy("i").collect()
    assert rows[0].s == "short" and rows[2].s == "" and rows[1].s.endswith("the end") and len(rows[1].s) == 16 * 1024 + 15
    assert len(rows[3].s) == 16 * 1024 + 15  # 18,000 bytes


def test_language_model_grows_with_its_landmarks():
    rng = np.random.default_rng(0)
    count = 60
    examples = [np.unique(rng.integers(0, language.CODES, 900, dtype=np.int32)) for _ in range(count * 8)]
    labels = np.repeat(np.arange(count), 8)
    model = language.Model([f"l{i}" for i in range(count)], examples, labels, np.arange(count * 8), 0.05)
    assert sum(v.nbytes + p.nbytes for _, v, p in model.blocks) < 10 << 20
    exact = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in examples] for a in examples[:5]])
    assert np.allclose(model.kernel(examples[:5]), exact, atol=1e-5)
