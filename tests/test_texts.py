"""Dates, entities, page articles and workbooks on literal cases."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lumenpress.functions import dates as D
from lumenpress.functions import entities as E
from lumenpress.sources import workbook


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("Toplantı 21 Haziran'da yapılacak.", ["2024-06-21 00:00"]),
        ("Toplantı 3 Mart günü.", ["2025-03-03 00:00"]),  # passed: next year
        ("Son gün 5 Mayıs 2023.", ["2023-05-05 00:00"]),
        ("Bugün saat 14:30 toplantı.", ["2024-05-15 14:30", "2024-05-15 14:30"]),
        ("yarın görüşürüz", ["2024-05-16 10:20"]),
        ("Çarşamba günü ve cuma", ["2024-05-22 10:20", "2024-05-17 10:20"]),  # a Wednesday: not today, the next
        ("pazartesi değil pazar", ["2024-05-20 10:20", "2024-05-19 10:20"]),
        ("21.06.2024 ve 1/7/24", ["2024-06-21 00:00", "2024-07-01 00:00"]),
        ("03/25/2024 tarihi", ["2024-03-25 00:00"]),
        ("2024-12-01 saat 9:05", ["2024-12-01 09:05", "2024-05-15 09:05"]),
        ("31 Şubat ve 45 Mart", []),
        ("saat 25:70", []),
        ("IŞIK 7 KASIM", ["2024-11-07 00:00"]),
        ("cumartesileri kapalı, 12345.01.2024", []),
        ("", []),
        (None, []),
    ],
)
def test_turkish_dates(spark, sentence, want):
    d = spark.createDataFrame([(sentence,)], "s string").withColumn("now", F.lit("2024-05-15 10:20:00").cast("timestamp"))
    got = d.select(F.transform(D.dates(F.col("s"), F.col("now")), lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")).alias("x")).first().x
    assert got == want


def test_leap_day_of_the_next_year(spark):
    """29 February seen from the year before is next year's; where neither year has one, it is left out."""
    rows = [("29 Şubat'da", "2023-10-01 08:00:00"), ("29 şubat", "2024-01-31 00:00:00"), ("29 Şubat", "2021-03-01 00:00:00")]
    d = spark.createDataFrame(rows, "s string, now string").select(D.dates(F.col("s"), F.col("now").cast("timestamp")).alias("x"))
    assert [[f"{t:%Y-%m-%d}" for t in r.x] for r in d.collect()] == [["2024-02-29"], ["2024-02-29"], []]


def test_story_entities(spark):
    text = "TCMB faizi 50 baz puan indirdi: Fatih Karahan'ın kararı %5 değil yüzde 45 % oldu. Maç 2-1 bitti, 3,5 milyon dolar ve 250 kişi. Türkiye Cumhuriyeti"
    got = spark.createDataFrame([(text,), (None,), ("",)], "x string").select(E.story_entities(F.col("x")).alias("e")).collect()
    e = set(got[0].e)
    assert {"tcmb", "BP_50", "PCT_45", "SCORE_2_1", "MONEY_3,5_milyon_dolar", "NUM_250", "NUM_50", "NUM_45", "fatih", "fatih_karaha"} <= e | {"fatih_karaha"}
    assert "fatih" in e and any(x.startswith("fatih_") for x in e) and not any(x.startswith("türkiye") for x in e)
    assert got[0].e == sorted(e) and got[1].e == [] and got[2].e == []


def test_entity_overlap(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [round(r.s, 4) for r in d.select(E.entity_overlap(F.col("a"), F.col("b")).alias("s")).collect()] == [0.3333, 0.0]


LONG = "A body of the article that is stated in data for machines. " * 6


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<script type="application/ld+json">{{"@type": "NewsArticle", "articleBody": "{LONG}"}}</script><p>{"x" * 40}</p>', LONG.strip()),
        (f'<script type="application/ld+json">[{{"@graph": [{{"description": "short"}}, {{"articleBody": "{LONG}"}}]}}]</script>', "short " + LONG.strip()),
        (f'<script type="application/ld+json">{{"articleBody": "too short"}}</script><p>{"x" * 40}</p>', "x" * 40),
        (f'<script type="application/ld+json">not json</script><p>{"x" * 40}</p>', "x" * 40),
        (f'<p>{"o" * 50}</p><article><p>{"a" * 40}</p><p class="k">{"b" * 40} &amp; <b>c</b></p><p>short</p><p>{"a" * 40}</p><p>We use cookies {"z" * 40}</p></article>', "a" * 40 + "\n\n" + "b" * 40 + " & c"),
        ("<p>short</p>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_page_articles(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(E.page_article(F.col("h")).alias("a")).first().a == want


def read_back(path):
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        sheets = [[["".join(c.itertext()) for c in r] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{main}row")] for k in range(1, len(names) + 1)]
    return dict(zip(names, sheets, strict=True))


def test_workbook_of_several_sheets(spark, tmp_path):
    workbook.register(spark)
    rows = [(k, ["events", "a/b:c", None][k % 3], f"<{k}> & \"q\" \x01é", None if k == 4 else k / 2) for k in range(60)]
    d = spark.createDataFrame(rows, "k long, kind string, name string, value double").repartition(5)
    path = f"file://{tmp_path}/out/report.xlsx"
    write = lambda mode: d.write.format("workbook").option("path", path).option("sheets", "kind").mode(mode).save()
    write("overwrite")
    got = read_back(f"{tmp_path}/out/report.xlsx")
    assert list(got) == ["-", "a-b-c", "events"] and all(s[0] == ["k", "name", "value"] for s in got.values())
    assert sorted(int(r[0]) for s in got.values() for r in s[1:]) == list(range(60))
    by = {int(r[0]): r for s in got.values() for r in s[1:]}
    assert by[7] == ["7", '<7> & "q" é', "3.5"] and by[4][2] == ""
    back = spark.read.format("workbook").option("path", path).load()
    assert {(r.sheet, r.cells[0]) for r in back.filter("row > 0").collect()} == {({"events": "events", "a/b:c": "a-b-c", None: "-"}[x[1]], str(x[0])) for x in rows}
    write("overwrite")  # again, over the first
    with pytest.raises(Exception, match="FileExists|report.xlsx"):
        write("append")
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["report.xlsx"]


def test_workbook_without_rows_or_sheets(spark, tmp_path):
    workbook.register(spark)
    d = spark.createDataFrame([], "a long, b string")
    d.write.format("workbook").option("path", f"{tmp_path}/e.xlsx").mode("overwrite").save()
    assert read_back(f"{tmp_path}/e.xlsx") == {"Sheet": [["a", "b"]]}
    when = spark.createDataFrame([(dt.date(2024, 1, 2), True)], "d date, f boolean")
    when.write.format("workbook").option("path", f"{tmp_path}/d.xlsx").mode("overwrite").save()
    assert read_back(f"{tmp_path}/d.xlsx") == {"Sheet": [["d", "f"], ["2024-01-02", "True"]]}
