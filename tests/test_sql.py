"""The SQL functions give what the column functions give, odd texts included."""

from pyspark.sql import functions as F

from diffloom import sql
from diffloom.functions.draws import draw
from diffloom.functions.text import collapse, first_line, lines, strip, words

TEXTS = [None, "", " \t\n", "a", "  a b c d \x1c e\n", "x\r\ny\x0bz\n", "\n\n", "one\ntwo", "é È\x85ü"]


def test_functions_agree_with_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, x string")
    sql.register(spark, {"texts": df})
    sql.register(spark, {"texts": df})  # again is no error
    got = spark.sql("""SELECT k, dl_words(x), dl_collapse(x), dl_strip(x), dl_lines(x), dl_first_line(x), dl_draw('s', x),
        dl_is_change(x, 'a') FROM texts ORDER BY k""").collect()
    want = df.select("k", words("x"), collapse("x"), strip("x"), lines("x"), first_line("x"), draw("s", "x"),
                     (F.col("x") != "") & (F.col("x") != "a")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_ngrams_of_short_arrays(spark):
    sql.register(spark)
    r = spark.sql("SELECT dl_ngrams(array('a', 'b', 'c'), 2), dl_ngrams(array('a'), 2), dl_ngrams(CAST(array() AS ARRAY<STRING>), 1)").first()
    assert list(r) == [[["a", "b"], ["b", "c"]], [], []]
