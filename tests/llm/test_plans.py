"""What is sent to the driver whole: nothing that goes apart, however small its file is."""

from __future__ import annotations

from lorespark.llm import spelling_groups


def test_words_that_go_apart_are_not_broadcast(spark):
    words = spark.createDataFrame([("abcdef", 50), ("abcdeg", 5), ("abcdeéf", 7)], "word string, n long")
    found = spelling_groups.variants(words)
    pairs = spelling_groups.near_pairs(words)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    for df in (found, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert sorted((r["word"], r["form"]) for r in found.collect()) == [("abcdef", None), ("abcdeg", "abcdef"), ("abcdeéf", "abcdef")]
