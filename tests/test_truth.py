from quarryline.plans import retrieval


def test_items_of_any_length_are_found_word_for_word(spark, tmp_path):
    texts = ["the quick brown fox jumps", "unquickly brownish", "a bc d", "xa bcx", "blanks  between", "", None, "short"]
    items = ["quick brown fox", "quick", "brown", "quickly brown", "a bc", "bc", "s  b", "short", "absent words here", "zz", "", None, "n fox j"]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in retrieval.truth(spark, f"file://{tmp_path}").collect()}
    assert got == {(i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t}
