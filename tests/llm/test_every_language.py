"""No language is left out, however many there are."""

from wavemill.llm import langid


def test_every_language(spark):
    docs = spark.createDataFrame([(i, f"word{i} text{i}", f"l{i:02}") for i in range(66)], "doc_id long, text string, lang string").coalesce(1)
    assert langid.fit(docs).languages == [f"l{i:02}" for i in range(66)]
