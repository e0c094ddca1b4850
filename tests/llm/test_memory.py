"""What one executor holds at once while texts and whole sets pass the Python workers of operators 10 and 11."""

import pyarrow as pa

from tidemark.llm import jaccard, minmax


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows]), "bytes": pa.array([b.nbytes])})


def test_batches_of_large_rows_are_small(spark):
    """Rows of 10 kB: 2,000 of them went to a worker at once, 20 MB."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with jaccard.small_batches(spark):
        got = rows.mapInArrow(_sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["bytes"] for r in got) < 2 * jaccard.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_sets_of_takes_one_worker_a_task(spark):
    """A filter in a worker of its own had the texts of each task in two workers."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, "x y z"), (3, None), (4, "e f")], "doc_id long, text string")
    digests = {r["rep"]: r["digest"] for r in minmax.profiles(docs, 2).selectExpr("doc_id AS rep", "digest").collect()}
    wanted = spark.createDataFrame([(7, 1, digests[1]), (8, None, digests[None])], "id long, rep long, digest binary")
    found = minmax.sets_of(docs, wanted, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("MapInArrow") == 1
    got = {r["id"]: len(r["shingles"]) // 8 for r in found.collect()}
    assert got == {7: 3, 8: 2}


def test_first_stages_of_the_pipeline_use_small_batches(spark, monkeypatch):
    """The workers of the first stages live on through the join: 10,000 whole texts at once stayed in their memory."""
    import corpus_pipeline

    seen = []
    for module, name in ((corpus_pipeline.rules, "judge"), (corpus_pipeline.cotrain, "classify")):
        monkeypatch.setattr(module, name, lambda docs, *a: seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or docs.selectExpr("*", "true AS kept"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.quality_classifier(spark, docs, "").columns == docs.columns
    assert seen == [str(jaccard.BATCH_BYTES)] * 2
