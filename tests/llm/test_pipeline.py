import corpus_pipeline
from logframe.llm.common import written
from tests.llm.cases import empty, hostile, plain_components
from tests.llm.test_links import base_spans

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        texts[name] = before, {r.doc_id: r.text for r in docs.collect()}
    before, after = texts["language"]
    assert after == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}
    before, after = texts["near_dedup"]
    groups, _ = plain_components(before, size=5)
    assert after == {d: t for d, t in before.items() if groups[d] == d}
    before, after = texts["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {d for d, t in before.items() if any(" ".join(i.lower().split()) in " ".join(t.lower().split()) for i in items)}
    assert holding and not holding & set(after)
    assert len(before) - len(after) <= 2 * len(holding) and all(before[d] == t for d, t in after.items())
    before, after = texts["secrets"]
    assert before.keys() == after.keys()
    assert all((before[d] == t) == (not base_spans(before[d]) and "[SECRET]" not in t) for d, t in after.items())
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert packed == set(after)


def test_hostile_rows_pass(spark):
    for table in (hostile(spark), empty(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), f"test-{name}")
