import re

import pytest

import corpus_pipeline
from privtrace.llm import queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    class Q:
        run, sql = staticmethod(queries.QUERIES[name]), queries.ORACLE[name]
    message, n, *_ = compare(spark, connect(SF), name, Q, SF)
    assert not message and n > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_give_a_row_per_row(spark, name):
    table = "pages" if name == "op3_html_text" else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_against_its_parts(spark):
    from .test_near_dedup import brute
    from privtrace.llm import byte_bpe, mixing, quality_classifier

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {t: i for i, t in sorted(text.items())}
    text = {i: t for t, i in last.items()}
    near = brute(sorted(text.items()), 5)
    text = {i: t for i, t in text.items() if near[i][1] == i}
    stay = docs.where(docs.doc_id.isin(list(text)))
    mixed = mixing.mix(stay).collect()
    got = corpus_pipeline.run(spark, SF).collect()
    copies = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in mixed}
    assert {i: sum(r.doc_id == i for r in got) for i in copies} == copies and len(got) == sum(copies.values())
    whole = {r.doc_id: r.n_tokens for r in byte_bpe.token_digests(stay).collect()}
    part = {r.doc_id for r in mixed if r.size and r.taken % r.size}
    assert all(r.n_tokens == whole[r.doc_id] for r in got if r.doc_id not in part)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
