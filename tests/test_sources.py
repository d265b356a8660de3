from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from skeinrisk.operators import holdings
from skeinrisk.sources import config, files, sinks

FACTOR_TEXT = """Some preamble
more of it

,Mkt-RF,SMB,HML,RMW,CMA,RF
20240102, 0.50,-0.10,0.20,0.00,0.10,0.02
20240103,-1.00, 0.30,0.10,0.05,0.00,0.02

 Annual: 
,Mkt-RF,SMB
2023, 20.0,1.0
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "five.csv").write_text(FACTOR_TEXT)
    with zipfile.ZipFile(tmp_path / "mom.zip", "w") as z:
        z.writestr("mom.csv", "x\n,Mom   \n20240103, 0.70\n20240104,0.1\nend\n")
    return f"file://{tmp_path}"


FIVE = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF"]


def test_factor_files(spark, folder):
    five = files.factor_block(files.lines(spark, f"{folder}/five.csv"), "Mkt-RF", FIVE)
    mom = files.factor_block(files.unzipped_lines(files.binary(spark, f"{folder}/mom.zip")), "Mom", ["MOM"])
    assert five.count() == 2 and five.columns == ["dt", *FIVE]
    rows = files.factors(five, mom).collect()
    assert len(rows) == 1 and rows[0]["dt"] == dt.date(2024, 1, 3) and rows[0]["mkt"] == pytest.approx(-0.01) and rows[0]["mom"] == pytest.approx(0.007)
    with pytest.raises(Exception, match="no header holds"):
        files.factor_block(files.lines(spark, f"{folder}/five.csv"), "nothing", FIVE).collect()


def test_each_factor_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",SMB,Mkt-RF\n20240102,1,2\n")
    (tmp_path / "b.csv").write_text("preamble\n\n,mkt-rf, Mkt-RF2,SMB\n20240103,2,9,1\n20240104,3\n\n")
    (tmp_path / "c.csv").write_text(",Mkt-RF\n20240105,4\n")
    rows = files.factor_block(files.lines(spark, f"file://{tmp_path}"), "kt-", ["Mkt-RF", "SMB"]).orderBy("dt").collect()
    assert [tuple(r)[1:] for r in rows] == [(2.0, 1.0), (2.0, 1.0), (3.0, None), (4.0, None)]


def test_factor_cache_stands_in(spark, folder, tmp_path):
    def load():
        return files.factor_block(files.lines(spark, f"{folder}/five.csv"), "Mkt-RF", FIVE).withColumnRenamed("Mkt-RF", "mkt")

    def broken():
        raise OSError("no network")

    def broken_in_a_task():
        return load().withColumn("mkt", F.when(F.col("mkt") < 0, F.raise_error(F.lit("cut off"))).otherwise(F.col("mkt")))

    cache = f"file://{tmp_path}/cache"
    for bad in (broken, broken_in_a_task):
        with pytest.raises(Exception, match="no network|cut off"):
            files.cached_factors(spark, bad, cache)
    assert files.cached_factors(spark, load, cache).count() == 2
    for bad in (broken, broken_in_a_task):
        assert files.cached_factors(spark, bad, cache).count() == 2


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for k in range(4):
        before = sinks.published(spark, path) if k else None
        sinks.publish(spark.range(k + 1), path)
        assert sinks.published(spark, path).count() == k + 1
        assert before is None or before.count() == k  # who still reads the version before, can
    assert len(sinks.versions(spark, path)) == 2


def test_dated_store_adds_new_dates_only(spark, tmp_path):
    schema = "portfolio string, model string, dt date, x double"
    store, seen = sinks.DatedStore(spark, f"file://{tmp_path}/store", schema), []
    days = [dt.date(2024, 1, k) for k in range(1, 6)]

    def rows(upto):
        def compute(last):
            seen.append({r["portfolio"]: r["last"] for r in last.collect()})
            return spark.createDataFrame([(p, "m", d, float(d.day)) for p in "ab" for d in days[:upto]], schema)
        return compute

    def failing(last):
        return rows(5)(last).withColumn("x", F.when(F.col("x") > 4, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))

    assert store.update(rows(3)).count() == 6
    with pytest.raises(Exception, match="lost"):
        store.update(failing)
    assert store.read().count() == 6
    assert sorted(map(tuple, store.update(rows(4)).collect())) == sorted((p, "m", d, float(d.day)) for p in "ab" for d in days[:4])
    assert seen[0] == {} and seen[-1] == {"a": days[2], "b": days[2]}


def docx(rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    return data.getvalue()


def xlsx(sheets):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            cells = lambda i, row: "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i + 1}"><v>{v}</v></c>' for j, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{m}"><sheetData>' + "".join(f'<row r="{i + 1}">{cells(i, row)}</row>' for i, row in enumerate(rows)) + "</sheetData></worksheet>")
    return data.getvalue()


def test_holdings_files(spark, tmp_path):
    (tmp_path / "ONE.csv").write_text('Holdings as of 5/5/2026\n\nName,Ticker,Weighting (%),Shares,Country,,\n"Micron, Inc",MU,6.5,"1,000",US,,\nCash,,1.0,,,,\nBad line,with,too,many,cells,x,y,z,q\n')
    (tmp_path / "TWO.xlsx").write_bytes(xlsx({"notes": [["nothing"]], "My Holdings": [["title"], ["Security Name", "Ticker", "Asset Type", "Percent of Net Assets"], ["Samsung", "005930 KS", "Equity", 0.05], ["Dollar", None, "Currency", 0.01]]}))
    (tmp_path / "THREE.docx").write_bytes(docx([["Name", "", "Shares", "Value"], ["Alpha Corp", "ALP", "1,000", "$ 300"], ["Alpha Corp", "ALP", "10", "100"], ["Beta", "5", "600"]]))
    (tmp_path / "BAD.csv").write_text("nothing here\n")
    tables = files.binary(spark, f"file://{tmp_path}/*.[cx][sl]*")
    rows = files.read_holdings(tables).collect()
    by = {f: [r for r in rows if r["fund"] == f] for f in ("ONE", "TWO", "BAD")}
    assert [(r["name"], r["ticker"], r["weight"]) for r in by["ONE"]] == [("Micron, Inc", "MU", "6.5"), ("Cash", None, "1.0")]
    assert {r["ticker"] for r in by["TWO"]} == {"005930 KS", None} and by["TWO"][0]["asset_type"] == "Equity"
    three = files.document_holdings(files.binary(spark, f"file://{tmp_path}/*.docx")).collect()
    assert {r["name"]: (r["ticker"], r["weight"], r["as_of"]) for r in three} == {"Alpha Corp": ("ALP", 40.0, None), "Beta": (None, 60.0, None)}
    bad = files.document_lots(files.binary(spark, f"file://{tmp_path}/BAD.csv")).first()
    assert bad["error"] and bad["name"] is None and by["ONE"][0]["as_of"] == dt.date(2026, 5, 5)
    assert by["BAD"][0]["error"] and by["BAD"][0]["name"] is None
    head = files.header_row(files.lines(spark, f"file://{tmp_path}/ONE.csv")).first()
    assert head["head"] == 2 and head["as_of"] == dt.date(2026, 5, 5)
    assert files.latest_file(spark, f"file://{tmp_path}", "*.csv").endswith("ONE.csv")
    good = files.read_holdings(tables).where("error IS NULL").drop("error")
    top = {(r["fund"], r["rank"]): r for r in holdings.normalise(good).collect()}
    assert top["TWO", 1]["weight"] == 5.0 and top["TWO", 1]["symbol"] == "005930.KS" and ("TWO", 2) not in top


def test_ranks_of_equal_weights_dont_depend_on_the_order_of_rows(spark):
    rows = [("F", "HOT RING INC", "nan", "1.5", None, c) for c in ("ECONOMY", "nan", " LARGE ", None, "SMALL")]
    schema = "fund string, name string, ticker string, weight string, asset_type string, country string"
    got = [[(r["rank"], r["country"]) for r in holdings.normalise(spark.createDataFrame(own, schema).coalesce(1)).orderBy("rank").collect()] for own in (rows, rows[::-1])]
    assert got[0] == got[1] == [(1, None), (2, None), (3, "ECONOMY"), (4, "LARGE"), (5, "SMALL")]


def test_documents_without_tickers(spark, tmp_path):
    """Names map to tickers, notes in brackets go, lots of one ticker are merged, and the quarter in the file's name is the date."""
    rows = [["Stocks 90%", "", ""], ["Alpha Corp (a)", "1,000", "$300"], ["Alpha ADR (EUR denominated)", "10", "100"], ["Beta", "5", "$", "600"], ["Note", "text", "5"]]
    (tmp_path / "FUND-Q2-2026.docx").write_bytes(docx(rows))
    tickers = spark.createDataFrame([("Alpha Corp", "ALP"), ("Alpha ADR", "ALP")], "name string, ticker string")
    got = files.document_holdings(files.binary(spark, f"file://{tmp_path}"), tickers).orderBy("name").collect()
    assert [(r["name"], r["ticker"], r["weight"], r["as_of"]) for r in got] == [("Alpha Corp", "ALP", 40.0, dt.date(2026, 6, 30)), ("Beta", None, 60.0, dt.date(2026, 6, 30))]


@pytest.mark.parametrize(("text", "day"), [("As of 05/31/2026", dt.date(2026, 5, 31)), ("31/12/2025", dt.date(2025, 12, 31)), ("on 2-3-26 it", dt.date(2026, 2, 3)), ("45/45/2026", None), ("none", None)])
def test_written_dates(text, day):
    assert files.written_date(text) == day


def test_json_round_trip(spark, tmp_path):
    doc = {"funds": {"F": {"as_of": "2026-05-05", "holdings": [{"security": "A", "ticker": "A", "weight": 3.0, "rank": 1}, {"security": "B", "ticker": "B", "weight": 1.0, "symbol": "B", "rank": 2}]}}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = files.disclosures(spark.read.text(f"file://{tmp_path}/d.json", wholetext=True))
    assert [(r["fund"], r["security"], r["symbol"]) for r in rows.orderBy("rank").collect()] == [("F", "A", None), ("F", "B", "B")]
    sinks.write_holdings(rows, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").first()["holdings"][1]["symbol"] == "B"


def test_document_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_document({"x": df, "y": df.limit(0)}, "2026-01-01", f"file://{tmp_path}/doc")
    got = json.loads(spark.read.text(f"file://{tmp_path}/doc").first()["value"])
    assert got["as_of"] == "2026-01-01" and sorted(r["k"] for r in got["x"]) == [1, 2] and got["y"] == []
    calls = []

    def compute():
        calls.append(1)
        return df

    for refresh in (False, False, True):
        assert sinks.cached(spark, compute, f"file://{tmp_path}/cache", refresh).count() == 2
    assert len(calls) == 2
    sinks.write_sections({"s": df}, f"file://{tmp_path}/sections")
    assert spark.read.parquet(f"file://{tmp_path}/sections/s").count() == 2


TAX = {"classes": {"eq": "eq", "us": "eq"}, "sectors": ["tech"], "securities": {"A": {"class": "us", "sector": "tech"}, "B": {"weights": {"us": 0.5, "eq": 0.5}}}}
BOOKS = {"benchmarks": {"m": {"label": "M", "weights": {"A": 1.0}}}, "portfolios": [{"id": "p", "benchmark": "m", "weights": {"A": 0.6, "B": 0.4}}, {"id": "hidden", "visible": False, "weights": {"A": 1}}, {"id": "look", "look_through": {"fund_ticker": "F", "top_n": 5}}]}
STRESS = {"historical": [{"id": "h", "start": "2000-01-01", "end": "2000-02-01"}], "hypothetical": [{"id": "y", "categories": {"us": -0.2, "tech": -0.3}, "shocks": {"A": 0.1}}], "proxies": {"B": "A"}}


def test_configuration_becomes_tables(spark):
    tax = config.taxonomy(TAX)
    t = config.tables(spark, config.portfolios(BOOKS), tax, config.scenarios(STRESS, tax))
    assert t["weights"].count() == 2 and t["shocks"].count() == 2 and t["securities"].count() == 2 and t["windows"].first()["start"] == dt.date(2000, 1, 1)


def test_many_files_are_read_where_they_are(spark):
    doc = lambda name, raw: (name, bytearray(yaml.safe_dump(raw).encode()))
    books = spark.createDataFrame([doc("a", BOOKS), doc("b", {"portfolios": [{"id": "x"}]}), ("c", bytearray(b"{: bad"))], files.FILES)
    read = config.read_portfolios(books).collect()
    assert sorted((r["portfolio"], r["ticker"], r["w"], r["ord"]) for r in read if r["error"] is None) == [("p", "A", 0.6, 0), ("p", "B", 0.4, 1)]
    assert sorted(r["path"] for r in read if r["error"]) == ["b", "c"]
    tree = config.read_taxonomy(spark.createDataFrame([doc("t", TAX)], files.FILES))
    assert {(r["class"], r["parent"]) for r in tree.collect()} == {("eq", "eq"), ("us", "eq")}
    known = spark.createDataFrame([("us",), ("tech",)], "category string")
    odd = {"hypothetical": [{"id": "odd", "categories": {"us": -0.1, "mars": -0.2}}, {"id": "fine", "categories": {"us": 0.1}}]}
    read = config.read_scenarios(spark.createDataFrame([doc("s", STRESS), doc("o", odd)], files.FILES), known).collect()
    assert {r["id"] for r in read if r["error"] is None} == {"h", "y", "fine"}
    assert {r["error"] for r in read if r["id"] == "odd"} == {"unknown categories mars"}


@pytest.mark.parametrize(
    ("check", "raw"),
    [
        ("portfolios", {"portfolios": [{"id": "p", "weights": {"A": -1}}]}), ("portfolios", {"portfolios": [{"id": "p", "weights": {"A": 1}}, {"id": "p", "weights": {"A": 1}}]}), ("portfolios", {"portfolios": [{"id": "p"}]}),
        ("portfolios", {"portfolios": [{"id": "p", "weights": {"A": 1}, "benchmark": "none"}]}), ("portfolios", {"portfolios": [{"id": "p", "weights": {"bad ticker": 1}}]}),
        ("taxonomy", {"classes": {"a": "b"}}), ("taxonomy", {"classes": {"a": "b", "b": "a"}}), ("taxonomy", {"classes": {"a": "a"}, "securities": {"X": {"class": "z"}}}), ("taxonomy", {"classes": {"a": "a"}, "securities": {"X": {"weights": {"a": 0.5}}}}),
        ("scenarios", {"historical": [{"id": "h", "start": "2001-01-01", "end": "2000-01-01"}]}), ("scenarios", {"historical": [{"id": "h", "start": "x", "end": "2000-01-01"}]}), ("scenarios", {"hypothetical": [{"id": "y", "categories": {"us": -20}}]}),
        ("scenarios", {"hypothetical": [{"id": "y", "categories": {"mars": -0.2}}]}), ("scenarios", {"proxies": {"A": "A"}}), ("scenarios", {"hypothetical": [{"id": "y"}, {"id": "y"}]}),
    ],
)
def test_odd_configurations_are_refused(check, raw):
    with pytest.raises(config.ConfigError):
        config.scenarios(raw, config.taxonomy(TAX)) if check == "scenarios" else getattr(config, check)(raw)


def test_unusual_shocks_warn():
    with pytest.warns(UserWarning, match="unusually large"):
        config.check_shock(-0.8, "here")
