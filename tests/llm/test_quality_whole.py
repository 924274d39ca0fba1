from helpers import DOC_SCHEMA
from parcelrisk.llm import quality as Q


def clean(n, stop="the of and to in"):
    stops = stop.split()
    return " ".join(f"{stops[i % len(stops)]} word{i}" for i in range(n // 2))


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)], DOC_SCHEMA)
    got = {r.doc_id for r in Q.keep_documents(df).collect()}
    assert got == {r.doc_id for r in Q.quality_measures(df).collect() if r.kept}
    return [i in got for i in range(len(rows))]


def test_a_clean_text_of_more_than_a_million_words_is_kept(spark):
    assert kept(spark, [(clean(1_000_100), "en")]) == [True]


def test_stop_words_count_in_any_case(spark):
    assert kept(spark, [(clean(200).upper(), "en"), (clean(200, "FÜR AUF"), "de"), (clean(200, "Le La"), "fr")]) \
        == [True] * 3


def test_the_stop_word_rule_holds_only_for_languages_with_a_list(spark):
    text = clean(200, "och att det som på")
    junk = " ".join(f"word{i}" for i in range(200))
    assert kept(spark, [(text, "sv"), (text, None), (junk, "en"), (junk, "en-US"), (junk, "FR"), ("# $ % " * 99, "sv")]) \
        == [True, True, False, False, False, False]


def test_without_a_language_column_the_rule_holds_for_all(spark):
    df = spark.createDataFrame([(1, clean(200)), (2, " ".join(f"word{i}" for i in range(200)))], "doc_id long, text string")
    assert [r.doc_id for r in Q.keep_documents(df).collect()] == [1]
