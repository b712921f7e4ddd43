from datetime import date

from pyspark.sql import functions as F

from newsweave.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_thinking(spark):
    for text, want in [("<think>a</think>b", "b"), ("<think>a\nb</think> c ", "c"), ("plain", "plain"), ("<think>only</think>", "<think>only</think>"), ("a<think>x</think>b<think>y</think>c", "abc")]:
        assert one(spark, T.strip_thinking(F.col("t")), t=text) == want


def test_url_keys(spark):
    key = lambda u: one(spark, T.url_key(F.col("u")), u=u)
    assert key("https://WWW.Example.com:443/a/b/?utm_source=x&z=1&a=2#top") == "example.com/a/b?a=2&z=1"
    assert key("http://example.com/a/b?a=2&z=1") == "example.com/a/b?a=2&z=1"
    assert key("no url") is None and key(None) is None


def test_dates(spark):
    when = lambda s: one(spark, F.date_format(T.feed_time(F.col("s")), "yyyy-MM-dd HH:mm"), s=s)
    assert when("Tue, 02 Jan 2024 03:04:05 GMT") == "2024-01-02 03:04"
    assert when("2024-01-02T03:04:05+02:00") == "2024-01-02 01:04"
    assert when("2024-01-02 03:04:05") == "2024-01-02 03:04"
    assert when("nonsense") is None
    lenient = lambda s: one(spark, T.lenient_date(F.col("s")), s=s)
    assert lenient("2025-04") == date(2025, 4, 1) and lenient("2025-Q3") == date(2025, 7, 1) and lenient("2025 or so") == date(2025, 1, 1)
    assert lenient("March 5, 2024") == date(2024, 3, 5) and lenient("5 March 2024") == date(2024, 3, 5)


def test_markup(spark):
    got = one(spark, T.chat_markup(F.col("t")), t="# Head\r\n**bold** [a](http://x) ~~no~~\n- item")
    assert got == "*Head*\n*bold* <http://x|a> ~no~\n• item"


def test_ratings(spark):
    rate = lambda s: one(spark, T.rating(F.col("s")), s=s)
    assert rate(" 3 ") == 3 and rate("x") == 2 and rate(None) == 2
