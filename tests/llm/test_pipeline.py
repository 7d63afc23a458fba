import corpus_pipeline
from reelframe.llm.secrets import find_secrets, redact
from reelframe.llm.toxicity import fit_severity, score_severity

from .test_packing import check_rows
from .test_simhash import slow_groups


def test_each_stage_equals_its_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    model = fit_severity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in score_severity(docs, model).where("toxic").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            want = {d: r for d, r in kept.items() if d not in toxic}
        elif name == "near_duplicates":
            rows = [(d, r.text) for d, r in kept.items()]
            firsts = set(slow_groups(rows))
            want = {d: r for d, r in kept.items() if d in firsts}
        else:
            want = {}
            for d, r in kept.items():
                clean = redact(r.text, find_secrets(r.text)) if r.text else r.text
                want[d] = r if clean == r.text else type(r)(d, clean, r.lang, r.source, len(clean))
        rows = got.collect()
        assert len(rows) == len(want) and {r.doc_id: tuple(r) for r in rows} == {d: tuple(r) for d, r in want.items()}
        kept, docs = {r.doc_id: r for r in rows}, spark.createDataFrame(rows, docs.schema)
    check_rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), {d: r.text for d, r in kept.items()})


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
