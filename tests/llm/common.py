"""Tables that every operator must take: nulls, empty and long texts, repeated rows, clashing column names, no rows."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, keys string, cluster string, start string"


def odd_documents(spark, empty=False):
    long_text = " ".join(f"word{i % 700} and" for i in range(30_000)) + "\n" + "x" * 200_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, long_text, "en", "a"), (4, long_text, "en", "a"), (5, long_text, None, "a"),
        (6, "one two three", "en", "a"), (7, "one two three", "en", "a"), (8, "!!! ??? 123", "en", None), (9, "Ünïcödé ßtring 日本語 \x00 end", "de", "a"), (None, "no id at all here today", "en", "a"),
    ]
    return spark.createDataFrame([] if empty else [(*r, 0, 0.5, "c", "k", "l", "s") for r in rows], SCHEMA)
