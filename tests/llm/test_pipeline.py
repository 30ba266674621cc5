"""The corpus pipeline and the corpus queries."""

import pytest
from compare import compare, make_duck

import corpus_pipeline
from sharelens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    problem, rows, _, _ = compare(spark, make_duck(SF), QUERIES[name], SQL[name], SF)
    assert not problem and rows


def test_native_queries_run_no_python(spark):
    from sharelens.llm import mixing, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (quality_rules.quality_rules(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, counts = docs, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == first.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    run = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "size", "taken").collect()}
    assert run == {tuple(r) for r in docs.select("doc_id", "size", "taken").collect()}


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
