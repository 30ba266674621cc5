"""Base counts against brute force; the divergence verdict."""

import re
import random

from corpus import edge_docs, prose, rows

from sharelens.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 3000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measured(spark, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    out = rules.measure(docs).collect()
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}


def test_base_counts(spark):
    rng = random.Random(1)
    texts = [t for _, t, *_ in rows()]
    texts += [" ".join(rng.choices("a b c #x é😀 |".split(), k=rng.randint(0, 60))) for _ in range(60)]
    texts += ["\n".join(rng.choices(["", " ", "line", "line ", "other one"], k=12)) for _ in range(20)]
    texts += ["a b c d e " * 40, "a b c d e", "a b c d e a b c d e", "x\r\ny\r\nx"]
    assert measured(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_histograms_add_up(spark):
    for r in rules.measure(edge_docs(spark, clashes=False)).collect():
        assert sum(r.class_counts) == len(r.text or "") and sum(r.word_counts) == r.n_words


def corpus(spark):
    good = [(i, prose(120 + i, i), "en") for i in range(60)]
    odd = [
        (100, " ".join(f"{w}***" for w in prose(200).split()), "en"),
        (101, prose(200, 5).upper(), "en"),
        (102, "same words again and again here " * 30, "en"),
        (103, "*** $$$ %%%", "en"),  # too short to be judged by its histogram, but fails the base rules
        (104, "??? !!! ;;; ... ,,, ::: ((( ))) ??? !!! ;;;", "en"),
        (105, prose(150, 9), None),
        (106, "слово " * 3 + " ".join(f"слово{i}" for i in range(200)), "ru"),
    ]
    return spark.createDataFrame(good + odd, "doc_id bigint, text string, lang string")


def test_verdict(spark):
    found = {r.doc_id: r for r in rules.quality_rules(corpus(spark)).collect()}
    assert not any(found[i].kept for i in (100, 101, 102, 103))
    assert found[104].kept and not found[104].base_failed and found[105].kept and found[106].kept
    assert all(found[i].kept == (not found[i].base_failed) for i in range(60))


def test_stage_keeps_the_same_documents(spark):
    docs = corpus(spark)
    kept = {r.doc_id for r in rules.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == kept


def test_without_references_the_base_rules_decide(spark):
    docs = spark.createDataFrame([(1, prose(80).upper(), None)], "doc_id bigint, text string, lang string")
    row = rules.quality_rules(docs).first()
    assert row.class_distance is None and row.kept == (not row.base_failed)


def test_distance(spark):
    from pyspark.sql import functions as F

    pair = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(rules.distance(pair(1.0, 0.0), pair(0.0, 1.0)), rules.distance(pair(0.5, 0.5), pair(0.5, 0.5))).first()
    assert tuple(row) == (1.0, 0.0)
