"""Workbooks (XLSX) as a source and a sink.

A workbook is a zip of XML parts. Files come through Spark's own reader of binary files,
so they may lie in any store that Spark reads; each sheet is parsed where its file is, as
a stream of XML events, row by row. A sheet has at most 1,048,576 rows by its format,
which bounds what one task parses; many files are many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a sheet, and the numbers of built-in date formats.
MOST_ROWS, DATE_FORMATS = 1_048_576, {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Rows of a sheet that are handed on at a time.
BATCH = 5_000
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    """An opened workbook: sheets by name, shared texts and the styles that are dates."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        found = [e for e in book.iter() if _local(e.tag) == "sheet"]
        self.sheets = {e.get("name"): place(links[e.attrib[next(k for k in e.attrib if k.startswith("{") and k.endswith("}id"))]]) for e in found}
        self.sheets = {k: v for k, v in self.sheets.items() if v in names}
        self.start = datetime(1904, 1, 1) if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter()) else datetime(1899, 12, 30)
        self.texts = list(self._texts()) if "xl/sharedStrings.xml" in names else []
        self.dates = self._dates() if "xl/styles.xml" in names else set()

    def _texts(self) -> Iterator[str]:
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) == "si":
                    yield "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
                    e.clear()

    def _dates(self) -> set[int]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in styles.iter() if _local(e.tag) == "numFmt"}
        dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE)}
        cells = next((e for e in styles if _local(e.tag) == "cellXfs"), [])
        return {k for k, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dated}

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        raw = next((e.text for e in cell if _local(e.tag) == "v"), None)
        if kind == "inlineStr":
            return "".join(e.text or "" for e in cell.iter() if _local(e.tag) == "t") or None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            at = self.start + timedelta(days=float(raw))
            at = (at + timedelta(microseconds=500_000)).replace(microsecond=0)
            return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
        return raw

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Row number (from 1) and its values by column, one row at a time; empty cells are left out."""
        row_no = 0
        with self.zip.open(self.sheets[sheet]) as f:
            root = None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if root is None:
                    root = e
                if event == "end" and _local(e.tag) == "row":
                    row_no = int(e.get("r", row_no + 1))
                    out, at = {}, -1
                    for cell in e:
                        where = _CELL.match(cell.get("r", ""))
                        at = column_number(where[1]) if where else at + 1
                        if (value := self._value(cell)) not in (None, ""):
                            out[at] = value
                    yield row_no, out
                    # parsed rows are forgotten
                    for child in root:
                        if _local(child.tag) == "sheetData":
                            child.clear()

    def header(self, sheet: str, row: int) -> dict[int, str]:
        """Column names of a header row by column; a name that comes again gets .1, .2, ..."""
        found = next((v for n, v in self.rows(sheet) if n >= row), {})
        names, seen = {}, {}
        for k in sorted(found):
            name = found[k].strip()
            seen[name] = seen.get(name, -1) + 1
            names[k] = f"{name}.{seen[name]}" if seen[name] else name
        return names


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that a path or pattern names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_names(files: DataFrame, header: int = 1) -> list[tuple[str, list[str]]]:
    """Sheets in the order of the first file that has them, with their column names; sheets without a header are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                book = Workbook(content)
                yield pd.DataFrame([(path, k, s, list(h.values())) for k, s in enumerate(book.sheets) if (h := book.header(s, header))], columns=["path", "place", "sheet", "columns"])

    out: dict[str, list[str]] = {}
    # a row a sheet
    for r in sorted(files.mapInPandas(run, "path string, place int, sheet string, columns array<string>").collect(), key=lambda r: (r["path"], r["place"])):
        known = out.setdefault(r["sheet"], [])
        known += [c for c in r["columns"] if c not in known]
    return list(out.items())


def sheet_table(files: DataFrame, sheet: str, columns: Sequence[str], header: int = 1) -> DataFrame:
    """The rows below the header row of one sheet of every file, all columns text; rows without any value are left out."""
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                book = Workbook(content)
                if sheet not in book.sheets:
                    continue
                first, held = None, []
                own: dict[int, str] = {}
                for n, row in book.rows(sheet):
                    if first is None:
                        if n < header:
                            continue
                        own, first = book.header(sheet, header), n
                        continue
                    if row:
                        named = {own[k]: v for k, v in row.items() if k in own}
                        held.append([named.get(c) for c in names])
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return files.mapInPandas(run, ", ".join(f"`{c.replace('`', '``')}` string" for c in names))


def read_workbook(source: SparkSession | DataFrame, path: str | None = None, header: int = 1, sheets: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables by sheet, of a path or of (path, content) rows; ``header`` is the row (from 1) that names the columns."""
    files = read_files(source, path) if path is not None else source
    return {s: sheet_table(files, s, columns, header) for s, columns in sheet_names(files, header) if sheets is None or s in sheets}


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_LINK = '<Relationship Id="rId{0}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{0}.xml"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _row_xml(n: int, values: Sequence[object]) -> str:
    cells = []
    for k, v in enumerate(values):
        if v is None or v != v:
            continue
        at = f"{column_letters(k)}{n}"
        if isinstance(v, bool):
            cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)) and v not in (float("inf"), float("-inf")):
            cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
        else:
            text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


def workbook_bytes(tables: dict[str, DataFrame], order: dict[str, Sequence[str]] | None = None, name: str = "workbook.xlsx", above: Sequence[str] = ()) -> DataFrame:
    """(path, content) of one workbook with a sheet a table; ``above`` are lines over each header row.

    Rows become XML where they are, then meet in one task, which the format bounds: a table
    of more rows than a sheet holds is refused. ``order`` names the columns that sort a sheet.
    """
    spark, parts = None, []
    for s, (sheet, df) in enumerate(tables.items()):
        spark = df.sparkSession
        if (n := df.count()) + len(above) >= MOST_ROWS:
            raise ValueError(f"a sheet holds fewer than {n} rows")
        names = df.columns
        keys = [F.col(f"`{c}`").cast("string") for c in (order or {}).get(sheet, ())]

        def cells(batches: Iterator[pd.DataFrame], names: list[str] = names, s: int = s) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                values = pdf[names].astype(object).itertuples(index=False)
                yield pd.DataFrame({"sheet": s, "key": pdf["_key"], "xml": [_row_xml(0, [x.item() if hasattr(x, "item") else None if x is pd.NaT else x for x in row]) for row in values]})

        parts.append(df.withColumn("_key", F.concat_ws("\1", *keys) if keys else F.lit("")).mapInPandas(cells, "sheet int, key string, xml string"))
    sheets, columns = list(tables), [df.columns for df in tables.values()]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", _TYPES.format("".join(_SHEET_TYPE.format(k + 1) for k in range(len(sheets)))))
            z.writestr("_rels/.rels", _ROOT)
            listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(sheets))
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", _ROOT.split("<Relationship ")[0] + "".join(_LINK.format(k + 1) for k in range(len(sheets))) + "</Relationships>")
            rows = rows.sort_values(["sheet", "key", "xml"], kind="stable")
            for k in range(len(sheets)):
                with z.open(f"xl/worksheets/sheet{k + 1}.xml", "w") as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    n = 0
                    for line in [[x] for x in above] + [columns[k]]:
                        n += 1
                        f.write(_row_xml(n, line).encode())
                    for xml in rows.loc[rows["sheet"] == k, "xml"]:
                        n += 1
                        f.write(re.sub(r'(<row r="|<c r="[A-Z]+)0"', rf'\g<1>{n}"', xml).encode())
                    f.write(b"</sheetData></worksheet>")
        return pd.DataFrame({"path": [name], "content": [out.getvalue()]})

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a sheet without rows still needs its header
    one = spark.createDataFrame([(-1, "", "")], "sheet int, key string, xml string")
    return every.unionByName(one).groupBy().applyInPandas(lambda pdf: build(pdf), "path string, content binary")
