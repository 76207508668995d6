import corpus_pipeline
from tests.llm import data
from tests.llm.test_near_dedup import plain

SF = "/root/testdata/sf0.001"


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
    rows = found.collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 1024


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    kept = corpus_pipeline.quality_rules(spark, docs, SF).join(labels.filter("quality = 1"), "doc_id").count()
    long = docs.filter("size(split(text, ' ')) > 60").join(labels.filter("quality = 1"), "doc_id").count()
    assert kept >= 0.97 * long


def test_odd_rows_pass_every_stage(spark):
    rows = data.odd_rows()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    left = corpus_pipeline.dedup_documents(spark, docs, SF)
    assert left.count() == sum(n if least != doc else 1 for (doc, _, least), n in plain(rows, 5).items() if doc == least)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).count()
