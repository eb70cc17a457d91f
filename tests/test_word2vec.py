from reviewlens.plans import queries as plans


def test_word2vec_cleans_its_rows_once(spark, tmp_path):
    rows = [(k, f"ngon quá giá rẻ {k} Hà Nội", "vi", "s", 10) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.queries()["word2vec"](spark, str(tmp_path))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 40 * 16
