DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)
