"""The pipeline's stages on a small fixture."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        after = docs.count()
        assert 0 < after <= before and docs.select("doc_id").distinct().count() == after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        before = after
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_planted_rows_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.table(spark, sf, "documents").filter("lang = 'en'").orderBy("doc_id").limit(40).collect()
    item = corpus_pipeline.table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    copy = max(rows, key=lambda r: len(r["text"]))
    planted = [(10_000, copy["text"], "en", "s", 0), (10_001, f"{rows[0]['text']} {item} {rows[1]['text']}", "en", "s", 0), (10_002, "1234", None, "s", 4)]
    planted.append((10_003, " ".join(reversed(rows[2]["text"].split())) + " mail someone@example.com now", "en", "s", 0))
    docs = spark.createDataFrame([*map(tuple, rows), *planted], corpus_pipeline.table(spark, sf, "documents").schema)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "stage")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert 10_002 not in kept[0] and 10_000 in kept[0]
    assert 10_000 not in kept[1] and copy["doc_id"] in kept[1] and 10_001 in kept[1]
    assert 10_001 not in kept[2]
    assert "someone@example.com" in kept[2][10_003] and "[email]" in kept[3][10_003]
