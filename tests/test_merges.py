"""Company merges, grades and rates on hand-made rows."""

from pyspark.sql import functions as F

from marketloom.operators import merges as G
from marketloom.sources import payloads as P


def test_companies_keep_what_is_not_overwritten(spark):
    stored = spark.createDataFrame([("A", "a", "tech", "x"), ("B", "b", None, "y"), ("C", "c", "", None)], "ticker string, name string, sector string, keywords string")
    new = spark.createDataFrame([("A", 1, "a2", "chips", ""), ("A", 2, "a3", "", None), ("B", 1, "b2", None, "z"), ("D", 1, "d", "", "")], "ticker string, seq int, name string, sector string, keywords string")
    got = {r.ticker: tuple(r)[1:] for r in G.merge_companies(stored, new).collect()}
    assert got == {"A": ("a3", "chips", "x"), "B": ("b2", "", "z"), "C": ("c", "", ""), "D": ("d", "", "")}
    assert G.merge_companies(stored, new.limit(0)).count() == 3 and G.merge_companies(stored.limit(0), new).count() == 3


def test_grades(spark):
    data = [("aa", "2024-02-01 10:00:00", "F", "UP", "Hold", "Buy"), ("aa", "2024-02-01", None, "weird", None, None), ("aa", "2023-12-01 00:00:00", "F", "up", "", ""), ("aa", "soon", "F", "up", "", ""), ("aa", None, "F", "up", "", "")]
    got = P.grades(spark.createDataFrame(data, "ticker string, graded_at string, firm string, action string, from_grade string, to_grade string"), "2024-02-20 00:00:00").orderBy("published_at").collect()
    assert [(r.ticker, r.firm, r.action_company, r.rating_prior, r.rating_current) for r in got] == [("AA", "", "weird", "", ""), ("AA", "F", "Upgrades", "Hold", "Buy")]
    import hashlib

    assert got[1].external_id == hashlib.sha1(b"yahoo|aa|2024-02-01 10:00:00|F|Upgrades|Hold|Buy").hexdigest()


def test_rates_from_a_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("DATE,GS2,GS10\n2024-01-02,4.1,3.9\n2024-01-03,.,3.9\n2024-01-04,4.0,NaN\nlater,4.0,3.9\n2024-01-05, 4.2 ,4\n")
    got = P.rates_csv(spark, str(tmp_path / "r.csv")).orderBy("trade_date").select(F.col("trade_date").cast("string"), "two_year", "ten_year").collect()
    assert [tuple(r) for r in got] == [("2024-01-02", 4.1, 3.9), ("2024-01-05", 4.2, 4.0)]
