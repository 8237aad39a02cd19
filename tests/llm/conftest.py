import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The same text of some words here and there", "en", "a", 5),
        (1, "The same text of some words here and there", "en", "a", 5),
        (2, "The same text of some words here and there", None, None, None),
        (None, "No id but words enough for shingles to form", "en", "a", 1),
        (3, None, "en", "b", 0),
        (4, "", "de", "b", 0),
        (5, " \t\n ", "de", None, 0),
        (6, "12345 !!! 😀", "fr", "c", 1),
        (7, long, "en", "c", 1),
        (8, long + " more", "en", "c", 1),
        (9, "ünï cödé é ß 日本語 текст 😀", None, "é", 1),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (10, "one\n\n\ntwo\n", "en", "a", 1),
    ]
    extra = "size long, shard string, slot int, score string, spans int, items string, n_words string, target string, taken int, copies int, pii int, n_lines int, kept_text int, lang_pred int, clean_text int, _id int, _size int, _range int, _text int, runs int"
    names = [c.split()[0] for c in extra.split(", ")]
    df = spark.createDataFrame(rows, DOCS)
    for c in extra.split(", "):
        name, kind = c.split()
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(7).cast(kind))
    assert set(names) <= set(df.columns)
    return df
