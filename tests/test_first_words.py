"""The words of a sample, cut from the beginning of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tokens as TK


def test_first_words_are_those_of_the_whole_text(spark):
    long_word = "x" * 300
    texts = [None, "", " \n", "one, two", "a b c d e f " * 50, f"{long_word} a b, c " * 9, "é́tude (naïve)... " * 40, "ΣΣ. ΑΣ.Β " * 30,
             "​" * 200 + "a b c d e f g", "word\x01s and spaces; " * 30, " " * 500 + "late words come here, after blanks"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (1, 5, 7):
        got = df.select("i", TK.first_words("t", most).alias("head"), F.slice(TK.split_words("t"), 1, most).alias("want")).collect()
        assert [r.head for r in got] == [r.want for r in got]
