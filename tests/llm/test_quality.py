import re
from collections import Counter

import pytest

from helpers import documents, sample_texts
from parcelrisk.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


CASES = [None, "", "  \n\t", "one", "a b c", "a a a a", "a b c a b c", "a b c x a b c a b c",
         "x y\nx y\nx y", "É 😀 # * $ % & | < >", " lead and trail ", "a\x85b c d",
         "w " * 5000, " ".join(f"w{i}" for i in range(60)), "same\n\nsame \nsame", "a b\x0bc\x0cd\re"]


def measured(df):
    return {r.doc_id: r for r in Q.quality_measures(df).collect()}


def test_measures_equal_plain_version(spark):
    rows = list(enumerate(CASES))
    rows += [(1000 + i, t) for i, t in sample_texts(spark)]
    got = measured(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, t in rows:
        r = got[i]
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("rule,keeps", [
    (Q.Rule("n_words", low=3), ["a b c", "# *** $$$ $$$"]), (Q.Rule("n_symbols", high=0), ["a b c", "one"]),
    (Q.Rule("mean_word_chars", low=2), ["one", "# *** $$$ $$$"])])
def test_each_rule_is_compiled(spark, rule, keeps):
    df = documents(spark, ["a b c", "one", "# *** $$$ $$$"])
    got = [r.text for r in Q.keep_documents(df, rules=(rule,), base_rules=()).collect()]
    assert sorted(got) == sorted(k for k in keeps)


def test_clean_text_of_each_language_is_kept(spark):
    texts = [" ".join(f"{w} {chr(97 + i % 26)}{j}{i}xyz" for j in range(3) for i, w in enumerate(ws))
             for ws in Q.STOP_WORDS.values()]
    assert Q.keep_documents(documents(spark, texts)).count() == len(texts)
    junk = " ".join(f"word{i}%%%" for i in range(200))
    assert Q.keep_documents(documents(spark, [junk])).count() == 0


def test_rows_pass_through(spark):
    df = documents(spark, [" ".join(f"the of word{i}" for i in range(60))] * 2 + [None], [None, 4, 4])
    df = df.selectExpr("*", "1 as n_words", "2 as `odd name`", "3 as __q_words")
    got = Q.keep_documents(df)
    assert got.columns == df.columns and got.count() == 2
    assert Q.keep_documents(documents(spark, [])).count() == 0


def test_plan_has_no_exchange_or_python(spark):
    df = documents(spark, ["x"])
    plan = Q.quality_measures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
