"""Pages of lots: what is read and how often a page is searched."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import extract
from tessera.plans import queries


def test_text_of_odd_pages(spark):
    pages = {
        "a<SCRIPT x>\n1</Script>b<Style>\n</sTYLE>c": "a b c", " \t\n a \x0b b\r\n\nc  d\te ": "a b c d e", "&NBSP;x&nBsp;&amp;nbsp;&Amp;quot;&quot;&#39;&QUOT;": 'x &nbsp;""\'&QUOT;',
        "<style><script></style></script>z</style>": "", "a  b  c": "a  b  c", "": "",
    }
    got = spark.createDataFrame([(h,) for h in pages], "h string").select("h", extract.plain_text(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in got} == pages


def test_rows_of_odd_pages(spark):
    html = "Cena sprzedaży: 1.234,50 zł Sell price:  Lot number: x12 Grade: a Grade: b Sale: s Data sprzedaży: 01.02.2003"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "Sell date: 31-02-2000 SELL PRICE: 5 usd")], "id int, h string")
    got = {r.id: tuple(r)[2:] for r in extract.lot_rows(rows, "h").collect()}
    assert got[1] == ("12", 1234.5, "PLN", dt.date(2003, 2, 1), "a Grade: b", None)
    assert got[2] == ("", None, "PLN", None, "", "no price") and got[3] == ("", 5.0, "USD", None, "", "no day")


def test_a_page_is_searched_once_for_each_label(spark):
    plan = queries.QUERIES["html_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    labels, others = 8, 5  # of two languages; the lot, the price and the parts of the day
    assert labels <= plan.count("regexp_extract(") <= labels + others
