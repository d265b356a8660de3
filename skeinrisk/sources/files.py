"""File sources: factor files, holdings files in csv, xlsx and docx, and JSON disclosures.

Such files are small and many: Spark lists and reads them, and each is parsed where it was read.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.holdings import merge_lots, number
from .sinks import publish, published, there


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line): the lines of text files, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def unzipped_lines(archives: DataFrame) -> DataFrame:
    """archives(path, content) -> (path, n, line) of the first file in each zip archive."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, data in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    text = z.read(z.namelist()[0]).decode("latin-1")
                out += [(name, n, x) for n, x in enumerate(text.splitlines())]
            yield pd.DataFrame(out, columns=["path", "n", "line"])

    return archives.mapInPandas(run, "path string, n int, line string")


def factor_block(text: DataFrame, hint: str, names: list[str]) -> DataFrame:
    """text(path, n, line) -> (dt, and a column for each of ``names``): the daily blocks of factor files.

    A file's header is its first line that begins with a comma and holds ``hint``; rows that begin with an eight-digit date follow,
    up to the first line that doesn't. Each file's own header says where its columns stand; names are matched without regard to
    case, and one that a file lacks is null in its rows. Reading a file without such a header raises.
    """
    own = Window.partitionBy("path")
    marked = text.withColumn("line", F.trim("line"))
    at = F.min(F.when(F.startswith("line", F.lit(",")) & F.contains("line", F.lit(hint)), F.col("n"))).over(own)
    missing = F.raise_error(F.concat(F.lit(f"no header holds {hint!r}: "), F.col("path"))).cast("int")
    marked = marked.withColumn("head", F.coalesce(at, missing)).where(F.col("n") >= F.col("head"))
    header = F.max(F.when(F.col("n") == F.col("head"), F.transform(F.split(F.lower("line"), ","), lambda x: F.trim(x)))).over(own)
    stop = F.min(F.when((F.col("n") > F.col("head")) & ~F.col("line").rlike(r"^\d{8}\s*(,|$)"), F.col("n"))).over(own)
    rows = marked.withColumn("header", header).withColumn("stop", stop).where((F.col("n") > F.col("head")) & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    cells = F.split("line", ",")
    # places count from 1, and 0 is none
    cell = lambda name: F.get(cells, F.nullif(F.array_position("header", F.lit(name.lower())), F.lit(0).cast("long")).cast("int") - 1)
    return rows.select(F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("dt"), *[F.trim(cell(x)).try_cast("double").alias(x) for x in names])


FACTOR_NAMES = {"Mkt-RF": "mkt", "SMB": "smb", "HML": "hml", "RMW": "rmw", "CMA": "cma", "RF": "rf"}


def factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Two factor blocks in percent -> (dt, mkt, smb, hml, rmw, cma, mom, rf) in decimals, on common dates."""
    mom = next(c for c in momentum.columns if c.lower().startswith("mom"))
    a = five.select("dt", *[(F.col(f"`{k}`") / 100).alias(v) for k, v in FACTOR_NAMES.items()])
    return a.join(momentum.select("dt", (F.col(f"`{mom}`") / 100).alias("mom")), "dt")


def cached_factors(spark: SparkSession, load, cache: str) -> DataFrame:
    """``load()``, published to ``cache``; what was published there before where loading fails, at any point."""
    try:
        publish(load(), cache)
    except Exception as e:  # noqa: BLE001 - whatever failed, an earlier download will do
        if not there(spark, cache):
            raise e from None
    return published(spark, cache)


#: How holdings files name their columns. A header names a ticker and one of the weight words.
WEIGHT_WORDS = ("percent of net assets", "weight", "% of", "weighting")
NAME_COLUMNS, TICKER_COLUMNS = ("security name", "security", "name"), ("ticker",)
WEIGHT_COLUMNS = ("weighting", "percent of net assets", "% of net", "weight", "% market")
KIND_COLUMNS, COUNTRY_COLUMNS = ("asset type", "asset class", "type"), ("country",)
#: Lines in which a header may stand.
HEADER_LINES = 12
_DATE = re.compile(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})")


def written_date(text: str) -> dt.date | None:
    """The first date in a text, month before day unless that is no date; None for a date that doesn't exist."""
    if not (found := _DATE.search(text)):
        return None
    first, second, year = map(int, found.groups())
    for month, day in ((first, second), (second, first)):
        try:
            return dt.date(year + 2000 * (year < 100), month, day)
        except ValueError:
            continue
    return None


def heading(rows: list[list[str | None]]) -> tuple[int | None, dt.date | None]:
    """(index of the header among the first rows, the first real date above it)."""
    said = [" | ".join(x for x in row if x) for row in rows[:HEADER_LINES]]
    head = next((k for k, x in enumerate(said) if "ticker" in x.lower() and any(w in x.lower() for w in WEIGHT_WORDS)), None)
    return head, next((d for x in said[:head] if (d := written_date(x))), None) if head is not None else None


def header_row(text: DataFrame) -> DataFrame:
    """text(path, n, line) -> (path, head, as_of) of the files that have a header among their first lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, as_of = heading([[x] for x in pdf.sort_values("n")["line"]])
        return pd.DataFrame([] if head is None else [(pdf["path"].iloc[0], head, as_of)], columns=["path", "head", "as_of"])

    return text.where(F.col("n") < HEADER_LINES).groupBy("path").applyInPandas(run, "path string, head int, as_of date")


def _match(names: list[str], wanted: tuple[str, ...]) -> str | None:
    return next((n for n in names if any(w in n.lower() for w in wanted)), None)


def holdings_rows(table: pd.DataFrame, fund: str, as_of: dt.date | None = None) -> pd.DataFrame:
    """A holdings table with named columns -> rows of ROWS_SCHEMA, columns found by their names."""
    names = [str(c) for c in table.columns]
    table = table.set_axis(names, axis=1)
    wanted = {"name": NAME_COLUMNS, "ticker": TICKER_COLUMNS, "weight": WEIGHT_COLUMNS, "asset_type": KIND_COLUMNS, "country": COUNTRY_COLUMNS}
    use = {k: _match(names, v) for k, v in wanted.items()}
    if not use["name"] or not use["weight"]:
        raise ValueError(f"no name or weight among {names}")
    out = pd.DataFrame({k: table[v] if v else None for k, v in use.items()}, dtype=object)
    out.insert(0, "fund", fund)
    out = out.where(out.notna(), None).astype(object).map(lambda v: None if v is None else str(v).strip())
    return out.assign(as_of=pd.Series([as_of] * len(out), dtype=object))


ROWS_SCHEMA = "fund string, name string, ticker string, weight string, asset_type string, country string, as_of date"


def _table(rows: list[list[str | None]]) -> tuple[pd.DataFrame, dt.date | None]:
    """The named columns below a header, and the date above it."""
    head, as_of = heading(rows)
    if head is None:
        raise ValueError("no header row")
    names = [x or "" for x in rows[head]]
    fitting = [r for r in rows[head + 1 :] if not any(r[len(names) :])]  # a row with more cells than the header is broken
    t = pd.DataFrame([(r + [None] * len(names))[: len(names)] for r in fitting], columns=names, dtype=object)
    t = t.replace("", None)
    return t[[c for c in t.columns if c.strip()]].dropna(how="all"), as_of


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of one sheet: the named one, else the first whose name holds 'holding', else the last."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_X + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = [(s.get("name"), s.get(_R + "id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_X + "sheet")]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        pick = next((s for s in sheets if s[0] == sheet), None) or next((s for s in sheets if "holding" in s[0].lower()), sheets[-1])
        root = ElementTree.fromstring(z.read("xl/" + target[pick[1]].removeprefix("/xl/").lstrip("/")))
    out = []
    for row in root.iter(_X + "row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(_X + "c"):
            v, kind = c.find(_X + "v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(_X + "t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            cells[_column(c.get("r"))] = text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


#: Notes in brackets that a disclosure's names carry, and the last day of each quarter.
NOTES = ("CAD denominated", "EUR denominated", "GBP denominated")
NAME_NOTES = re.compile(rf"\s*\((?:[a-z]|{'|'.join(NOTES)})\)\s*")
QUARTER_ENDS = {"1": (3, 31), "2": (6, 30), "3": (9, 30), "4": (12, 31)}


def quarter_end(name: str) -> dt.date | None:
    """The last day of the quarter that a file's name holds, as Q1-2026."""
    found = re.search(r"Q([1-4])[-_](\d{4})", name)
    return dt.date(int(found[2]), *QUARTER_ENDS[found[1]]) if found else None


def docx_lots(data: bytes) -> list[tuple[str, str | None, float]]:
    """(name, ticker in the document or None, value) of the rows of a document's tables that end in shares and value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    amount = re.compile(r"\$?\s*[\d,]+(\.\d+)?")
    out = []
    for row in root.iter(_W + "tr"):
        cells = [("".join(t.text or "" for t in c.iter(_W + "t"))).strip() for c in row.iter(_W + "tc")]
        said = [c for c in cells[1:] if c and c != "$"]
        name = " ".join(NAME_NOTES.sub(" ", cells[0]).split()) if cells else ""
        if len(said) < 2 or not all(amount.fullmatch(c) for c in said[-2:]) or not name or "%" in name:
            continue
        out.append((name, next((c for c in said if re.fullmatch(r"[A-Z]{1,5}", c)), None), float(re.sub(r"[^\d.]", "", said[-1]))))
    if not out:
        raise ValueError("no holdings rows")
    return out


FILES = "path string, content binary"


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


LOTS_SCHEMA = "fund string, ord int, name string, ticker string, value double, as_of date, error string"


def document_lots(documents: DataFrame) -> DataFrame:
    """documents(path, content) -> (fund, ord, name, ticker, value, as_of, error): the lots that docx files list, in their order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, data in zip(part["path"], part["content"], strict=True):
                fund = path.rsplit("/", 1)[-1].rpartition(".")[0]
                try:
                    out += [(fund, k, *lot, quarter_end(fund), None) for k, lot in enumerate(docx_lots(data))]
                except Exception as e:  # noqa: BLE001 - failures of one file are reported in its row
                    out.append((fund, 0, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOTS_SCHEMA.split(", ")])

    return documents.mapInPandas(run, LOTS_SCHEMA)


def document_holdings(documents: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """documents(path, content), tickers(name, ticker) -> (fund, name, ticker, weight, as_of): lots of one ticker, or of one name
    where there is none, as one holding, in percent of the document's value. ``tickers`` go before those in the document."""
    lots = document_lots(documents).where("error IS NULL")
    if tickers is not None:
        lots = lots.alias("l").join(tickers.alias("t"), "name", "left").select("fund", "ord", "name", F.coalesce("t.ticker", "l.ticker").alias("ticker"), "value", "as_of")
    merged = merge_lots(lots).join(lots.groupBy("fund").agg(F.max("as_of").alias("as_of")), "fund")
    return merged.select("fund", "name", F.when(F.col("key") != F.col("name"), F.col("key")).alias("ticker"), "weight", "as_of")


def read_holdings(tables: DataFrame, sheet: str | None = None) -> DataFrame:
    """tables(path, content) -> (fund, name, ticker, weight, asset_type, country, as_of, error): rows of csv and xlsx files, the file's
    name as fund and the date above the header as as_of.

    A file that can't be read gives one row with the error and nothing else, and stops no other.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                fund, _, kind = name.rsplit("/", 1)[-1].rpartition(".")
                try:
                    cells = xlsx_rows(data, sheet) if kind == "xlsx" else list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
                    table, as_of = _table(cells)
                    rows = holdings_rows(table, fund, as_of).assign(error=None)
                except Exception as e:  # noqa: BLE001 - failures of one file are reported in its row
                    rows = pd.DataFrame([(fund, *[None] * 6, str(e))], columns=["fund", "name", "ticker", "weight", "asset_type", "country", "as_of", "error"])
                yield rows

    return tables.mapInPandas(run, ROWS_SCHEMA + ", error string")


def disclosures(documents: DataFrame) -> DataFrame:
    """documents(value), JSON as {funds: {ticker: {as_of, holdings: [...]}}} -> one row a holding."""
    holding = "struct<security: string, ticker: string, weight: double, symbol: string, country: string, rank: int>"
    funds = documents.select(F.from_json("value", f"funds map<string, struct<as_of: string, holdings: array<{holding}>>>").alias("d"))
    return funds.select(F.explode("d.funds").alias("fund", "f")).select("fund", F.to_date("f.as_of").alias("as_of"), F.inline("f.holdings"))


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The last path by name that matches."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select(F.max("path").alias("p")).first()
    return found["p"] if found else None


__all__ = ["binary", "cached_factors", "disclosures", "document_holdings", "document_lots", "docx_lots", "factor_block", "factors", "header_row", "holdings_rows", "latest_file", "lines", "number", "read_holdings", "unzipped_lines", "xlsx_rows"]
