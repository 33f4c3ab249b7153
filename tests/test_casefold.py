"""Case folding as an expression and in SQL is Python's, over all code points."""

from pyspark.sql import functions as F

from factloom.functions import exprs as E
from factloom.functions.registry import register_functions


def test_all_code_points(spark):
    every = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    texts = ["".join(every[i : i + 1000]) for i in range(0, len(every), 1000)] + every[:3000] + ["Straße", "ŞİŞLİ", "ﬁnal oﬃce", "K", "ſs", "", "PLAIN Text 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    register_functions(spark)
    rows = df.select("t", E.casefold(F.col("t")).alias("a"), F.expr("fl_casefold(t)").alias("b")).collect()
    assert all(r.a == r.t.casefold() and r.b == r.a for r in rows)


def test_tokens_and_scores(spark):
    import re

    df = spark.createDataFrame([("Straße ŞİŞLİ ﬁnal K-1 ſ", "https://x.org/STRASSE/final/ﬃ?k=S"), (None, "x"), ("a", None)], "q string, u string")
    rows = df.select("*", E.search_tokens(F.col("q")).alias("tokens"), E.relevance_score(E.search_tokens(F.col("q")), F.col("u")).alias("n")).collect()
    wanted = set(re.findall("[a-z0-9]+", rows[0].q.casefold()))
    assert set(rows[0].tokens) == wanted and rows[0].n == sum(t in rows[0].u.casefold() for t in wanted)
