"""Workbooks and figures against plain readers and writers."""

import io
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import lineage
from tideline.sources import figures as G
from tideline.sources import readers
from tideline.sources import workbook as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets, shared=(), styles="", date1904=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}>{'<workbookPr date1904=\"1\"/>' if date1904 else ''}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="x{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="165"/></cellXfs>'


def test_cells_of_every_kind(spark, tmp_path):
    content = book(
        {
            "Log": '<row r="1"><c r="A1" t="s"><v>0</v></c></row>',
            "Data": '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3" t="s"><v>1</v></c><c r="AB3" t="inlineStr"><is><t>far</t></is></c></row>'
            '<row r="4"><c r="A4"><v>1.5</v></c><c r="B4"><v>9</v></c><c r="C4" s="1"><v>45000</v></c><c r="D4" s="3"><v>45000.75</v></c><c r="AB4" t="str"><f>A4</f><v>f</v></c></row>'
            '<row r="6"><c r="A6" t="b"><v>1</v></c><c r="C6" t="e"><v>#N/A</v></c><c r="D6" s="4"><v>7</v></c></row><row r="7"/>'
            "<row><c><v>8</v></c><c><v>3</v></c><c t=\"inlineStr\"><is><r><t>a </t></r><r><t>&lt;b&gt;</t></r></is></c></row>",
            "Empty": "",
        },
        ["<r><t>Sub</t></r><r><t>jectID</t></r>", "<t> Day </t>"],
        STYLES,
    )
    (tmp_path / "one.xlsx").write_bytes(content)
    (tmp_path / "two.xlsx").write_bytes(book({"Data": '<row r="3"><c r="A3" t="inlineStr"><is><t>more</t></is></c><c r="B3" t="inlineStr"><is><t>SubjectID</t></is></c></row><row r="4"><c r="A4"><v>1</v></c><c r="B4" s="2"><v>0</v></c></row>'}, styles=STYLES, date1904=True))
    sheets = W.read_workbook(spark, str(tmp_path), header=3)
    assert list(sheets) == ["Data"] and sheets["Data"].columns == ["SubjectID", "Day", "Day.1", "far", "more"]
    assert {tuple(r) for r in sheets["Data"].collect()} == {
        ("1.5", "2023-03-15", "2023-03-15 18:00:00", "f", None),
        ("true", None, "7", None, None),
        ("8", "a <b>", None, None, None),
        ("1904-01-01", None, None, None, "1"),
    }
    assert list(W.read_workbook(spark, str(tmp_path / "one.xlsx"))) == ["Log", "Data"]


def test_round_trip_of_a_workbook(spark, tmp_path):
    rows = [(f"TRACKFA_{k:04d}", k, None if k % 3 else k / 7, k % 2 == 0, 'x < "y" & é\n' if k % 5 == 0 else "") for k in range(12_345)]
    df = spark.createDataFrame(rows, "SubjectID string, n long, v double, odd boolean, text string").repartition(4)
    files = W.workbook_bytes({"notes & more": df.limit(0), "Main": df}, {"Main": ["SubjectID"]}, above=["a title"])
    assert [p.rsplit("/", 1)[1] for p in G.write_files(files, str(tmp_path))] == ["workbook.xlsx"]
    sheets = W.read_workbook(spark, str(tmp_path / "workbook.xlsx"), header=2)
    assert list(sheets) == ["notes & more", "Main"] and sheets["notes & more"].count() == 0
    got = {(r.SubjectID, int(r.n), None if r.v is None else float(r.v), r.odd == "true", r.text or "") for r in sheets["Main"].collect()}
    assert got == set(rows)
    assert readers.choose_sheet(sheets, ["TRACKFA_"]) == "Main"
    with zipfile.ZipFile(tmp_path / "workbook.xlsx") as z:
        assert z.testzip() is None and b'<c r="A3" t="inlineStr"><is><t xml:space="preserve">TRACKFA_0000</t>' in z.read("xl/worksheets/sheet2.xml")


def test_columns_have_letters():
    assert [W.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(W.column_number(W.column_letters(k)) == k for k in range(2000))


def decoded(content):
    assert content[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, size = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        assert struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size[1], size[0] + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_scatter_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=3000), rng.normal(size=3000)
    x[:500], y[:500] = 0.25, 0.5
    rows = [*zip(x.tolist(), y.tolist()), (None, 1.0), (float("nan"), 1.0), (99.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(4)
    bounds = (-2.0, 2.0, -1.0, 3.0)
    want = np.zeros((20, 30), dtype=np.int64)
    for a, b in zip(x, y):
        if -2 <= a <= 2 and -1 <= b <= 3:
            want[19 - min(int(np.floor((b + 1) / 4 * 20)), 19), min(int(np.floor((a + 2) / 4 * 30)), 29)] += 1
    pixels = G.scatter(df, "x", "y", 30, 20, bounds)
    got = np.zeros_like(want)
    for r in pixels.collect():
        got[r.py, r.px] = r.n
    assert (got == want).all()
    assert (decoded(G.png(pixels, 30, 20).first().content) == G.shade(want, want.max())).all()
    assert (decoded(G.png(pixels.where("false"), 30, 20).first().content) == 255).all()
    flat = G.scatter(df.where("x = 0.25"), "x", "y", 30, 20).collect()
    assert [tuple(r) for r in flat] == [(15, 9, 500)]
    with pytest.raises(ValueError, match="at most"):
        G.png(pixels, 10_000, 10_000)


def test_boxes_are_drawn(spark):
    table = spark.createDataFrame([("a", 0.0, 0.25, 0.5, 0.75, 1.0), ("b", 0.5, 0.5, 0.5, 0.5, 2.0)], "g string, low double, q1 double, median double, q3 double, high double")
    got = {(r.px, r.py) for r in G.boxes(table, "g", 40, 20).collect()}
    want = {(x, y) for x in range(5, 16) for y in (14, 9, 4)} | {(x, y) for x in (5, 15) for y in range(4, 15)} | {(10, y) for y in [*range(14, 20), *range(5)]}
    assert {p for p in got if p[0] < 20} == want
    assert {p for p in got if p[0] >= 20} == {(x, 9) for x in range(25, 36)} | {(30, y) for y in range(10)}
    assert decoded(G.png(G.boxes(table, "g", 40, 20), 40, 20).first().content).shape == (20, 40)


def test_bars_stand_on_zero(spark):
    table = spark.createDataFrame([("a", 3.0), ("b", -1.0), ("c", None), (None, 2.0), ("d", float("nan"))], "g string, v double")
    got = {(r.px, r.py): r.n for r in G.bars(table, "g", "v", 16, 8).collect()}
    # -1 to 3 over eight rows: zero lies in row 5 from the top, 3 in row 0, -1 in row 7
    assert got == {(x, y): 1 for x in range(2, 6) for y in range(6)} | {(x, y): 1 for x in range(10, 14) for y in (5, 6, 7)}
    ranked = {r.px for r in G.bars(table, "g", "v", 16, 8, order=F.col("v")).where("py = 0").collect()}
    assert ranked == set(range(10, 14))
    edge = {r.py for r in G.bars(table.where("g = 'a'"), "g", "v", 16, 8, (-1.0, 1.0)).collect()}
    assert edge == set(range(4))
    twice = G.bars(table.unionByName(table), "g", "v", 16, 8).select("n").distinct().collect()
    assert [r.n for r in twice] == [2]
    assert G.bars(table.limit(0), "g", "v").count() == 0
    with pytest.raises(ValueError, match="bars"):
        G.bars(table, "g", "v", 2, 8)


def test_kept_tables_go_with_their_scope(spark):
    def there(df):
        return Path(df.inputFiles()[0].removeprefix("file:")).parent

    with lineage.scope(spark):
        first = lineage.kept(spark.range(10))
        with lineage.scope(spark):
            inner = there(lineage.kept(spark.range(5)))
        assert first.count() == 10 and not inner.exists()
        outer = there(first)
    assert not outer.exists()
    one, two = lineage.kept(spark.range(3)), lineage.kept(spark.range(4))
    place = there(one)
    lineage.forget(one)
    lineage.forget(one)
    lineage.forget(spark.range(3))
    assert not place.exists() and two.count() == 4
