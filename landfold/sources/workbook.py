"""Workbooks (Office Open XML) read and made by Spark's tasks, a workbook each, with nothing but the standard library.

`scan` reads the files of a path as binary rows, so any file system that Spark reads will do, and parses a sheet's XML as a
stream: strings come from the shared table or the cell, numbers as they are written, dates by the cell's style, truth
values as TRUE and FALSE, errors as their text. With a limit a sheet is left after so many rows. `books` makes workbooks of
rows, BOOK_ROWS or so each, as binary values.

Defined results: the first row that has a cell names the columns (empty names become `Column n`, a repeated name gets .1,
.2 ...); cells are text; an empty cell is null; rows without any cell don't count; cells beyond the last name are left out; a
file that is no workbook, or lacks the sheet, is an error that names it, or gives no rows with `rejects=False`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a workbook that `books` makes, about; rows of a sheet and characters of a cell at most. What is beyond is refused, not cut.
BOOK_ROWS, SHEET_ROWS, CELL = 50_000, 1_048_575, 32_767
#: Namespaces, and the built-in number formats that show a date or a time.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: What XML can't hold, and how workbooks write it.
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
CODED = re.compile("_x([0-9A-Fa-f]{4})_")


class Book:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        top = self._tree("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): self._path(links[s.get(LINK)]) for s in top.iter(MAIN + "sheet")}
        self.epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in top.iter(MAIN + "workbookPr")) else datetime(1899, 12, 30)
        self.strings, self.dated = self._strings(), self._dated()

    @staticmethod
    def _path(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else "xl/" + target

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.names:
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == MAIN + "si":
                    out.append(_said(e))
                    e.clear()
        return out

    def _dated(self) -> list[bool]:
        """Of each cell style, whether it shows a date."""
        if "xl/styles.xml" not in self.names:
            return []
        styles = self._tree("xl/styles.xml")
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(MAIN + "numFmt")}
        is_date = lambda n: n in DATES or n in own and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[n].lower())) is not None
        return [is_date(int(x.get("numFmtId", 0))) for group in styles.iter(MAIN + "cellXfs") for x in group]

    def _value(self, c: ElementTree.Element) -> str | None:
        kind, v = c.get("t", "n"), c.find(MAIN + "v")
        if kind == "inlineStr":
            inner = c.find(MAIN + "is")
            return None if inner is None else _said(inner) or None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)] or None
        if kind == "b":
            return "TRUE" if v.text in ("1", "true") else "FALSE"
        style = int(c.get("s", 0))
        if kind == "n" and style < len(self.dated) and self.dated[style]:
            at = self.epoch + timedelta(microseconds=round(float(v.text) * 86_400_000) * 1000)
            return at.isoformat(" ") if at.time().isoformat() != "00:00:00" else at.date().isoformat()
        return _decoded(v.text)

    def rows(self, sheet: str | int) -> Iterator[list[str | None]]:
        """Rows that have a cell, as long as their last cell's place."""
        name = sheet if isinstance(sheet, str) else [*self.sheets][sheet]
        with self.zip.open(self.sheets[name]) as f:
            place = 0
            row: list[str | None] = []
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    continue
                if e.tag == MAIN + "c":
                    place = _column(e.get("r")) if e.get("r") else len(row) + 1
                    row += [None] * (place - len(row))
                    row[place - 1] = self._value(e)
                    e.clear()
                elif e.tag == MAIN + "row":
                    if any(x is not None for x in row):
                        yield row
                    row = []
                    e.clear()


def _said(e: ElementTree.Element) -> str:
    """The text of a string item: its runs, without readings."""
    return _decoded("".join(t.text or "" for t in [*e.findall(MAIN + "t"), *(t for r in e.findall(MAIN + "r") for t in r.findall(MAIN + "t"))]))


def _decoded(text: str) -> str:
    return CODED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _letters(n: int) -> str:
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def header(first: list[str | None]) -> list[str]:
    """Names for columns, each once."""
    out: list[str] = []
    for i, name in enumerate(first, 1):
        base = name or f"Column {i}"
        name, n = base, 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


FOUND = "path string, sheet string, names array<string>, row long, cells array<string>"
_FOUND = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("names", pa.list_(pa.string())), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])


def found(books: DataFrame, sheet: str | int | None = 0, limit: int | None = None, rejects: bool = True) -> DataFrame:
    """FOUND of (path, content): the rows of a sheet (None: of all), numbered from 1; names stand in row 0, without cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    book = Book(content)
                    wanted = [*book.sheets] if sheet is None else [sheet if isinstance(sheet, str) else [*book.sheets][sheet]]
                    if missing := set(wanted) - book.sheets.keys():
                        raise KeyError(f"no sheet {missing.pop()}")
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as e:
                    if rejects:
                        raise ValueError(f"{path} can't be read as a workbook: {e}") from e
                    continue
                for name in wanted:
                    held, names = [], None
                    for n, cells in enumerate(book.rows(name)):
                        if names is None:
                            names = header(cells)
                            held.append((path, name, names, 0, None))
                            continue
                        if limit is not None and n > limit:
                            break
                        held.append((path, name, None, n, (cells + [None] * len(names))[: len(names)]))
                        if len(held) >= 2_000:
                            yield _batch(held)
                            held = []
                    yield _batch(held)

    return books.select("path", "content").mapInArrow(run, FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan(spark: SparkSession, path: str, sheet: str | int = 0, limit: int | None = None, rejects: bool = True) -> DataFrame:
    """The rows of a sheet of one or many workbooks of one layout: a text column for each name, in the order of the first file's."""
    first = found(binary(spark, path), sheet, 0, rejects).where("names is not null").orderBy("path").select("names").first()
    names = first["names"] if first else []
    rows = found(binary(spark, path), sheet, limit, rejects).where("cells is not null")
    return rows.select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, columns, total (rows) of every sheet."""
    return found(binary(spark, path), None).groupBy("path", "sheet").agg(F.max("names").alias("columns"), F.count("cells").alias("total"))


TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{sheets}</Types>"""
RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'


def _cell(ref: str, value, style: str = "") -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 1 << 53 or isinstance(value, float) and value - value == 0:
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if len(str(value)) > CELL:
        raise ValueError(f"{ref}: a cell holds {CELL} characters")
    text = CODED.sub(lambda m: f"_x005F{m[0]}", str(value))
    text = BAD.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{ref}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


def made(sheets: dict[str, tuple[list[str], Iterator[tuple]]]) -> bytes:
    """A workbook: a bold first row of names on each sheet, columns as wide as their longest value, from 10 to 50."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
        z.writestr("[Content_Types].xml", TYPES.format(sheets="".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}"/>' for i in range(1, len(sheets) + 1))))
        z.writestr("_rels/.rels", RELS.format(links=f'<Relationship Id="r" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/>'))
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", RELS.format(links="".join(f'<Relationship Id="r{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="s" Type="{OFFICE}/styles" Target="styles.xml"/>'))
        for i, (names, rows) in enumerate(sheets.values(), 1):
            widths, body = [len(n) for n in names], io.StringIO()
            for n, row in enumerate([names, *rows], 1):
                if n > SHEET_ROWS + 1:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
                widths = [max(w, len(str(v))) if v is not None else w for w, v in zip(widths, row, strict=True)]
                body.write(f'<row r="{n}">' + "".join(_cell(f"{_letters(j)}{n}", v, ' s="1"' if n == 1 else "") for j, v in enumerate(row, 1)) + "</row>")
            cols = "".join(f'<col min="{j}" max="{j}" width="{min(50, max(10, w + 2))}" customWidth="1"/>' for j, w in enumerate(widths, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body.getvalue()}</sheetData></worksheet>')
    return out.getvalue()


def books(df: DataFrame, key: str, sheet: str = "Sheet1", rows: int = BOOK_ROWS) -> DataFrame:
    """path, content: workbooks of all rows of df, dealt by the hash of a column into as many as `rows` asks for, in order of it."""
    n = max(1, -(-df.count() // rows))
    names = df.columns
    # equal keys come by several parts, so that one key can't overfill a book
    dealt = df.withColumn("__book", F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def make(group: pa.Table) -> pa.Table:
        number = group.column("__book")[0].as_py()
        held = group.drop_columns(["__book"]).sort_by(key).to_pylist()
        return pa.table({"path": [f"{sheet}-{number:06d}.xlsx"], "content": pa.array([made({sheet: (names, [tuple(r.values()) for r in held])})], pa.binary())})

    return dealt.groupBy("__book").applyInArrow(make, "path string, content binary")
