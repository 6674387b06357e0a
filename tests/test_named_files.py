"""Files named by their split: a split is written by more than one task."""

from checks import QUERIES


def test_a_split_has_several_files(spark, tmp_path):
    docs = [(i, "en", "src0", f"text {i}") for i in range(400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").repartition(8).write.parquet(path)
    found = QUERIES["s1_read_corpus_by_file_name"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(i, t) for i, _, _, t in docs]
    names = [f.rsplit("/", 1)[-1] for f in found.inputFiles()]
    assert sum(n.startswith("train-") for n in names) > 1 and any(n.startswith("dev_") for n in names)
