"""Classification reads texts to their end."""

from tessera.operators import classify


def test_words_behind_20000_characters_count(spark):
    term = sorted(classify.TYPES["CLINICAL"].split())[:4]
    text = "zzz " * 6000 + " ".join(term * 500)
    documents = spark.createDataFrame([(1, "a.txt", text)], "doc_id bigint, source string, text string")
    assert classify.detect(documents).first().data_type == "CLINICAL"
    assert classify.lexicon_hits(documents).count() > 0 and classify.lexicon_hits(documents, sample=20000).count() == 0
