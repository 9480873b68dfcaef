from kura.llm import line_dedup


def test_texts_are_merged_at_every_size(spark):
    text = "\n".join(f"line {i} of a passage that two texts have" for i in range(9))
    df = line_dedup.dedup(spark.createDataFrame([(1, text), (2, text + "\nmore"), (3, "other")], "doc_id long, text string"))
    assert {(r.doc_id, r.text, r.n_removed) for r in df.collect()} == {(1, text, 0), (2, "more", 9), (3, "other", 0)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
