"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: no operator may stumble."""

import pytest
from corpus import benchmark, edge_docs, labels, rows

from sharelens.llm import decontaminate, language, mixing, pii, quality_cnn, quality_rules, simhash, toxicity

OPERATORS = {
    "language": lambda s, d: language.identify(d, language.train(d)),
    "quality_cnn": lambda s, d: quality_cnn.score(d, quality_cnn.train(d, labels(s), epochs=1)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s), epochs=1)),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "pii": lambda s, d: pii.find_pii(d),
    "simhash": lambda s, d: simhash.components(d),
    "mixing": lambda s, d: mixing.mix(d),
}


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result_and_partitions_do_not_matter(spark, name):
    one = plain(OPERATORS[name](spark, edge_docs(spark)))
    other = plain(OPERATORS[name](spark, edge_docs(spark, clashes=False, partitions=7)))
    assert len(one) == len(rows()) and repr(one) == repr(other)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, edge_docs(spark).where("false")).count() == 0


@pytest.mark.parametrize("stage", [quality_rules.keep_good, simhash.keep_one, pii.redact])
def test_filters_keep_columns(spark, stage):
    docs = edge_docs(spark)
    kept = stage(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert stage(docs.where("false")).count() == 0


def test_decontamination_keeps_columns(spark):
    docs = edge_docs(spark)
    kept = decontaminate.drop_contaminated(docs, benchmark(spark))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {3, 4, 5, 6, 7, 10, None, 2**62} and ids.count(10) == 1 and ids.count(None) == 2
    assert decontaminate.drop_contaminated(docs, benchmark(spark).where("false")).count() == docs.count()


def test_one_document_per_group(spark):
    kept = sorted((r.doc_id for r in simhash.keep_one(edge_docs(spark)).collect() if r.doc_id is not None))
    assert 2 not in kept and kept.count(1) == 1 and kept.count(8) == 1 and kept.count(3) == 1 and 4 not in kept and 5 not in kept
