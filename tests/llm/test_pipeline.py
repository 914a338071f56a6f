import corpus_pipeline
from millrace.llm import decontamination, line_spread, parity_join, queries, quality_rules


def test_stages_follow_each_other(spark, tiny):
    """``run`` gives what the operators give one after the other."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "sentencepiece"]
    docs = quality_rules.keep_good(docs, quality_rules.fit_rules(docs, labels))
    docs = line_spread.remove_boilerplate(docs)
    docs = parity_join.keep_one(docs)
    docs = decontamination.drop_leaking(docs, items)
    expected = sorted(map(tuple, queries.piece_digests(docs).collect()))
    found = sorted(map(tuple, corpus_pipeline.run(spark, tiny).collect()))
    assert found == expected and 0 < len(found) < 200


def test_stages_keep_the_columns_of_odd_documents(spark, tiny, odd_rows):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_rows, odd_rows.limit(0)):
            left = stage(spark, docs, tiny)
            assert left.columns == docs.columns
            assert left.count() <= docs.count()
