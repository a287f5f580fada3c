"""Every query on odd tables and on empty ones, with defined results."""

import pytest
from odd_tables import odd_documents

from quillmill.llm.entry import oracle_sql, queries

PER_ROW = ["op2_token_planes", "op3_secret_scan", "op4_minhash", "op5_quality_rules", "op6_lm_score", "op7_line_dedup", "op9_quality_net"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty(spark, empty, name):
    assert queries()[name](spark, empty).count() == (1 if name == "op1_chat_format" else 0)


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows_each_get_a_result(spark, odd, name):
    got = queries()[name](spark, odd).collect()
    ids = lambda rows: sorted(rows, key=lambda i: (i is None, i or 0))
    assert ids([r.doc_id for r in got]) == ids([d[0] for d in odd_documents()])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_odd_matches_sql(spark, odd, compare, name):
    got, expected = compare(spark, queries()[name], oracle_sql()[name], odd)
    assert got == expected


def test_pipeline_on_odd_and_empty(spark, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 10
    packed = corpus_pipeline.packing(spark, docs, odd)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_stages_against_plain_python(spark, small):
    """What each stage keeps of a whole table, from what its predecessor kept."""
    import re
    from collections import defaultdict

    import corpus_pipeline
    from plain_leaks import leaks
    from quillmill.llm import quality_net
    from test_brute import plain_components

    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000")
    model = quality_net.train(docs, labels)
    before = [(r.doc_id, r.text) for r in docs.collect()]
    kept = dict(zip([i for i, _ in before], model.probabilities([quality_net.octets(t) for _, t in before]) >= corpus_pipeline.QUALITY, strict=True))
    docs = spark.createDataFrame(corpus_pipeline.quality(spark, docs, small).collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {i for i, k in kept.items() if k} and not all(kept.values())

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    texts, holders = {r.doc_id: r.text for r in docs.collect()}, defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i < max(holders[key(x)])
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}
    docs = spark.createDataFrame(corpus_pipeline.line_dedup(spark, docs, small).collect(), docs.schema)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    component = plain_components([(i, t, None) for i, t in texts.items()], corpus_pipeline.NEAR_PERCENT)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    docs = spark.createDataFrame(corpus_pipeline.near_dedup(spark, docs, small).collect(), docs.schema)
    assert {r.doc_id: r.text for r in docs.collect()} == texts

    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    short = {i for i, t in texts.items() if len(t) < 1500}
    found = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, small).collect()}
    assert found & short == {i for i in short if not leaks(items, texts[i])} and found <= set(texts)


def test_no_labels_gives_one_rate(spark, odd):
    from quillmill.llm import quality_net

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    model = quality_net.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r._score for r in quality_net.score(docs, model, columns=["doc_id"]).collect()} == {0.5}
