import corpus_pipeline
from tracewise.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF), "test")
        after = docs.count()
        assert 0 < after <= before
        before = after
        if name != "sentencepiece":
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0


def test_near_duplicates_stage(spark):
    """A copy without its last 53 words: five-word Jaccard 243/296 = 0.821, four-word 244/297 = 0.822."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:247])), (3, " ".join(words[:230]))]    # 226/296 = 0.76
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two, far = docs.where("doc_id < 3"), docs.where("doc_id <> 2")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, two, SF).collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, far, SF).collect()) == [1, 3]
