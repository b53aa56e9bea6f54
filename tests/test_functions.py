import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from lexmill.functions import text, values


def one(spark, column, **given):
    names = ", ".join(f"{k} string" for k in given) or "x string"
    return spark.createDataFrame([tuple(given.values()) or ("",)], names).select(column.alias("r")).first().r


def test_space_slugs_and_suffixes(spark):
    assert one(spark, text.squeeze(F.col("x")), x="  a  \n b\t") == "a b"
    assert one(spark, text.slugify(F.col("x")), x=" Työ & Ehdot! ") == "ty-ehdot"
    assert one(spark, text.slug_to_title(F.col("x"), [("tyo", "työ")]), x="/a/b/YLI-tyo/") == "Yli työ"
    strip = text.strip_suffixes(F.col("x"), ["sopimus", "alan"])
    assert one(spark, strip, x="Kaupan alan SOPIMUS") == "Kaupan" and one(spark, strip, x="sopimus") == "sopimus"
    assert one(spark, text.scrub(F.col("x"), ["##"]), x="a\x07##  b\n\n\n\nc") == "a b\n\nc"
    assert one(spark, text.clean_name(F.col("x"), ["valid"]), x="Long na-\nme of it valid until") == "Long name of it"
    assert one(spark, text.plain_dashes(F.col("x")), x="a–b—c­d") == "a-b-cd"


def test_links_and_markup(spark):
    assert one(spark, text.absolute_url(F.col("h"), F.col("b")), h="/x", b="https://a.b/c/d") == "https://a.b/x"
    assert one(spark, text.absolute_url(F.col("h"), F.col("b")), h="e", b="https://a.b/c/d") == "https://a.b/c/e"
    assert one(spark, text.statute_code(F.col("x")), x="https://a/laki/2001/20010055") == "55/2001"
    assert one(spark, text.statute_code(F.col("x")), x="https://a/laki/2019/872") == "872/2019"
    assert one(spark, text.html_escape(F.col("x")), x="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    rows = F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))
    assert one(spark, text.markdown_table(rows)) == "| h | k |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"


def test_statute_numbers_that_begin_like_their_year(spark):
    code = lambda x: one(spark, text.statute_code(F.col("x")), x=x)
    assert code("https://x.fi/laki/1991/199111") == "199111/1991" and code("https://x.fi/laki/2012/20122/") == "20122/2012"
    assert code("https://x.fi/laki/2001/20010000") == "0/2001" and code("https://x.fi/laki/2001/2001") == "2001/2001"
    assert code("https://x.fi/laki/2001/20020055") == "20020055/2001"


def test_matches_have_places(spark):
    found = one(spark, text.matches(F.col("x"), r"(a+)(b)?", 2), x="é🙂aab-a")
    assert [(m.start, m.end, m.g) for m in found] == [(2, 5, ["aab", "aa", "b"]), (6, 7, ["a", "a", ""])]
    assert one(spark, text.matches(F.col("x"), "q", 0), x="abc") == []
    assert one(spark, text.excerpt(F.col("x"), F.lit(3), F.lit(4), 2, 2), x="ab  c  d") == "b c"


def test_numbers(spark):
    amount = values.locale_decimal(F.col("x"))
    assert one(spark, amount, x="1 746,50") == Decimal("1746.50") and one(spark, amount, x="2 000.") == 2000
    assert one(spark, amount, x="none") is None
    word = values.number_word(F.col("x"))
    assert [one(spark, word, x=w) for w in ("Kahden", "kymmeneltä", "12", "moni")] == [2, 10, 12, None]
    assert one(spark, values.percent(F.lit(1), F.lit(8))) == Decimal("12.5") and one(spark, values.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, values.tenure_months(F.lit("4_8y"))) == 48


def test_dates(spark):
    day = values.dmy(F.col("x"))
    assert one(spark, day, x="1.6.2023") == datetime.date(2023, 6, 1) and one(spark, day, x="31.2.2025") is None
    assert one(spark, values.dmy_as_iso(F.col("x")), x="31.2.2025") == "2025-02-31"
    assert one(spark, values.iso_date(F.col("x")), x="2025-13-01") is None
    both = values.validity(F.col("t"), F.col("p"))
    got = one(spark, both, t="voimassa 1.2.2024 alkaen, 2020-2022", p="2018-2019")
    assert got.first == datetime.date(2024, 2, 1) and got.last is None
    got = one(spark, both, t="nothing", p="2018–2019")
    assert (got.first, got.last) == (datetime.date(2018, 1, 1), datetime.date(2019, 12, 31))


def test_hash_recipes(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, text.content_hash([F.col("a"), F.col("b")]), a="x", b="y") == sha("xy")
    assert one(spark, text.content_hash(F.array(F.lit(" a "), F.lit(" "), F.lit("b")), "\n", True)) == sha("a\nb")
