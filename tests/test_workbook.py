import io
import zipfile
from datetime import date, datetime

import pytest

from landfold.sources import files, sinks, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PACKAGE = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def book(sheets, strings="", styles="", epoch=""):
    """A workbook written by hand, as other programs write them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}>{epoch}<sheets>{''.join(f'<sheet name="{n}" sheetId="{i}" r:id="x{i}"/>' for i, n in enumerate(sheets))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {PACKAGE}>{''.join(f'<Relationship Id="x{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


STRINGS = "<si><t>id</t></si><si><r><t>na</t></r><r><rPr><b/></rPr><t>me</t></r><rPh sb='0' eb='1'><t>reading</t></rPh></si><si><t xml:space='preserve'> a_x000D_&#10;b </t></si><si><t/></si>"
STYLES = '<numFmts count="2"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;[Red]"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs>'
ROWS = (
    '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c></row><row r="4"/>'
    '<row r="5"><c r="A5"><v>7</v></c><c r="B5" t="s"><v>2</v></c><c r="C5" s="1"><v>45293</v></c><c r="D5" s="4"><v>45293.5</v></c><c r="E5"><v>9</v></c></row>'
    '<row r="6"><c r="B6" t="b"><v>1</v></c><c r="C6" s="2"><v>1</v></c><c r="D6" s="3"><v>2.50</v></c></row>'
    '<row r="7"><c r="A7" t="e"><v>#DIV/0!</v></c><c r="B7" t="str"><f>A1</f><v>made</v></c><c r="C7" t="inlineStr"><is><t>in</t></is></c><c r="D7" t="s"><v>3</v></c></row>'
    "<row><c><v>1E-3</v></c><c/><c><v>4</v></c></row>"
)
WANT = [("7", " a\r\nb ", "2024-01-02", "2024-01-02 12:00:00"), (None, "TRUE", "1899-12-31", "2.50"), ("#DIV/0!", "made", "in", None), ("1E-3", None, "4", None)]


def landed(tmp_path, **books):
    for name, content in books.items():
        (tmp_path / f"{name}.xlsx").write_bytes(content)
    return str(tmp_path)


def test_scan(spark, tmp_path):
    other = '<row><c t="inlineStr"><is><t>only</t></is></c></row>'
    path = landed(tmp_path, a=book({"One": ROWS, "Two &amp; more": other, "Three": ""}, STRINGS, STYLES))
    got = files.xlsx(spark, path)
    assert got.columns == ["id", "name", "Column 3", "id.1"] and [tuple(r) for r in got.collect()] == WANT
    assert [tuple(r) for r in files.xlsx(spark, path, "One", 2).collect()] == WANT[:2] and files.xlsx(spark, path, 0, 0).count() == 0
    assert files.xlsx(spark, path, 1).columns == ["only"] and files.xlsx(spark, path, 1).count() == 0
    assert files.xlsx(spark, path, "Three").columns == []
    totals = {r.sheet: (r.columns, r.total) for r in workbook.totals(spark, path).collect()}
    assert totals == {"One": (["id", "name", "Column 3", "id.1"], 4), "Two & more": (["only"], 0)}
    old = landed(tmp_path / ".", a=book({"One": ROWS}, STRINGS, STYLES, '<workbookPr date1904="1"/>'))
    assert files.xlsx(spark, old).collect()[0][2] == "2028-01-03"


def test_files_that_are_no_workbooks(spark, tmp_path):
    path = landed(tmp_path, a=b"no zip", b=book({"S": '<row><c><v>1</v></c></row><row><c><v>2</v></c></row>'}), c=b"")
    with pytest.raises(Exception, match="a.xlsx can't be read|c.xlsx can't be read"):
        files.xlsx(spark, path).collect()
    assert [tuple(r) for r in workbook.scan(spark, path, rejects=False).collect()] == [("2",)]
    assert workbook.scan(spark, path, "none", rejects=False).columns == []


def test_sheets_that_are_written_are_read(spark, tmp_path):
    values = [(1, "a<b>&\"'", 2.5, True, None, ["x"]), (2, "  \r\n\t\x01_x0041_ ", -0.0, False, "", []), (None, "é東🙂", 1e300, None, "=1+1", None)]
    df = spark.createDataFrame(values, "id int, `odd & name` string, n double, ok boolean, t string, tags array<string>")
    when = spark.createDataFrame([(date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5))], "d date, at timestamp")
    path = str(tmp_path / "x.xlsx")
    sinks.sink("excel")({"first": df, "empty": df.limit(0), "second": when}, path)
    got = files.xlsx(spark, path)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [("1", "a<b>&\"'", "2.5", "TRUE", None, '["x"]'), ("2", "  \r\n\t\x01_x0041_ ", "-0.0", "FALSE", None, "[]"), (None, "é東🙂", "1e+300", None, "=1+1", None)]
    assert [tuple(r) for r in files.xlsx(spark, path, "second").collect()] == [("2024-01-02", "2024-01-02 03:04:05")]
    assert workbook.totals(spark, path).count() == 2
    sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert '<col min="1" max="1" width="10"' in sheet and '<c r="B1" t="inlineStr" s="1">' in sheet
    with pytest.raises(ValueError):
        sinks.write_workbook({"s": spark.range(11)}, str(tmp_path / "y.xlsx"), most_rows=10)


def test_books_hold_every_row_once(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(7, "same")] * 300
    df = spark.createDataFrame(rows, "id int, t string")
    made = workbook.books(df, "id", rows=100)
    got = workbook.found(made).where("cells is not null").collect()
    assert sorted((int(r.cells[0]), r.cells[1]) for r in got) == sorted(rows)
    sizes = {r.path: r["count"] for r in workbook.found(made).where("cells is not null").groupBy("path").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 200
    assert workbook.books(df.limit(0), "id").count() == 0
