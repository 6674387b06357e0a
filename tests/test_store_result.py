"""Tables that lead to a stored result go with it; segmented texts are not moved twice."""

import os

from lexmill.session import materialize, scratch_root, store_result


def test_tables_on_the_way_are_deleted(spark):
    def tables():
        return {x.rsplit("-", 1)[0] for x in os.listdir(scratch_root(spark).removeprefix("file:"))} if os.path.isdir(scratch_root(spark).removeprefix("file:")) else set()

    kept = materialize(spark.range(3), "before_it")

    def steps():
        inner = store_result(spark, lambda: materialize(kept, "innermost").filter("id > 0"), "inner_result")
        assert "inner_result" in tables() and "innermost" not in tables()
        return materialize(inner, "on_the_way")

    out = store_result(spark, steps, "the_result")
    assert sorted(r.id for r in out.collect()) == [1, 2] and kept.count() == 3
    assert {"before_it", "the_result"} <= tables()
    assert not {"innermost", "inner_result", "on_the_way"} & tables()
    materialize(spark.range(1), "after_it")
    assert "after_it" in tables()


def test_sampled_query_moves_no_texts_after_the_ids_are_stored(spark, tmp_path):
    from checks import QUERIES

    texts = ["ab cd ab " * 20, "x\ny ab", "ab cd", "zz " * 60]
    rows = [(i, "en" if i % 2 else "fr", "web", texts[i % 4].strip()) for i in range(24)]
    spark.createDataFrame(rows, "doc_id int, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["t7_tokenize_sampled"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "AS n_drawn" in plan
    assert sorted((r.lang, r.n_docs, r.n_same_text) for r in out.collect()) == [("en", 12, 12), ("fr", 12, 12)]
    assert all(r.n_more_ids > 0 for r in out.collect())
