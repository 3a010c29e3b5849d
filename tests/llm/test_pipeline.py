import corpus_pipeline
from ledgerloom.llm import registry


def test_stages_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    groups = {r.doc_id: r.component_id for r in registry.op5(spark, sf_dir).collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        counts.append((name, len(rows)))
        ids = {r.doc_id for r in rows}
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "near_duplicates":
            assert ids == set(groups.values())
        if name == "repeated_passages":
            assert all(r.text in before[r.doc_id].text or len(r.text) < len(before[r.doc_id].text) for r in rows)
            assert any(len(r.text) < len(before[r.doc_id].text) for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "benchmark_leaks":
            assert 0 < len(ids) < counts[-2][1]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows)


def test_nulls_repeats_and_empty_table(spark, tmp_path):
    rows = [(1, "le petit chat est dans la maison et le chien dort ici " * 3, "fr", None, None), (1, "le petit chat est dans la maison et le chien dort ici " * 3, "fr", None, None), (None, "the cat is in the house and the dog sleeps here", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5), (5, "the dog and the cat are in the garden", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang) for r in got) == [(False, 1, "fr"), (False, 5, "en"), (True, 0, "en")]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), str(tmp_path))
        assert docs.count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river at noon"
    other = "a wholly different report tells of prices that rose in spring and fell again before winter came"
    third = "these words belong to a text without any number and they appear in two rows of the table"
    rows = [(1, base), (2, base), (2, other), (None, third), (None, third), (None, base), (7, "1 2"), (7, "1 2")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, base), (2, other), (0, third), (7, "1 2")])


def test_no_labels_and_decoding(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sleeps", None, "s", 14), (2, "the dog runs", None, "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert sorted(r.decoded for r in corpus_pipeline.tokens(spark, left, str(tmp_path)).collect()) == ["the cat sleeps", "the dog runs"]
