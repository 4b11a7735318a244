"""Tests of what round 4 found too slow in the training-data operators; each makes its own rows."""

from __future__ import annotations

from pricetrail.llm import secretscan


def test_words_of_a_text_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = secretscan.candidates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert plan.count("regexp_extract_all(") == 6


def test_words_without_a_digit_are_told_by_what_stands_before(spark):
    plain = "correcthorsebatterystaple"
    texts = [
        f"password={plain}", f"password: {plain}", f"secret = {plain}", f"<token>{plain}</token>", f"password {plain}", f"a = {plain}",
        f"secret => {plain}", f"the {plain}", plain, "", None, f"x=1 {plain}", f"api_key:\t{plain}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in secretscan.candidates(docs).collect() if r["value"] == plain}
    assert found == {0, 1, 2, 3, 6, 12}
