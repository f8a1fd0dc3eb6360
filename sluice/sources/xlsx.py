"""Workbook (.xlsx) scan: many files in parallel, one task per workbook.

``binaryFile`` lists the workbooks; ``mapInPandas`` parses each one with the
standard library (zip + XML): shared and inline strings, booleans, numbers,
cached formula results, and dates recognised from the cell's number format
(1900 date system). Cells come out as text in the shapes the transform step
parses (integral numbers without a fraction, dates as ``yyyy-MM-dd``,
date-times as ``yyyy-MM-dd HH:mm:ss``); empty rows are skipped and ``_row``
is the sheet row number.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from decimal import Decimal
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# built-in number formats that display dates or times
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
EPOCH_1900 = dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _is_date_format(code: str) -> bool:
    stripped = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return re.search(r"[dmyhs]", stripped, re.IGNORECASE) is not None


def _number_text(raw: str, is_date: bool) -> str:
    if is_date:
        value = float(raw)
        moment = EPOCH_1900 + dt.timedelta(days=value)
        moment = moment.replace(microsecond=0) if abs(moment.microsecond) < 500 else moment
        if moment.time() == dt.time(0, 0):
            return moment.date().isoformat()
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    d = Decimal(raw)
    if d == d.to_integral_value():
        return str(int(d))
    return format(d.normalize(), "f")


def parse_workbook(content: bytes, sheet_name: str | None = None, sheet_index: int = 0) -> list[tuple[int, dict[int, str]]]:
    """(sheet row number, {column index: text}) for every non-empty row."""
    zf = zipfile.ZipFile(io.BytesIO(content))
    names = set(zf.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
    date_styles: set[int] = set()
    if "xl/styles.xml" in names:
        st = ET.fromstring(zf.read("xl/styles.xml"))
        custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in st.findall("m:numFmts/m:numFmt", NS)}
        for i, xf in enumerate(st.findall("m:cellXfs/m:xf", NS)):
            fid = int(xf.get("numFmtId", "0"))
            if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_format(custom[fid])):
                date_styles.add(i)
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    sheets = wb.findall("m:sheets/m:sheet", NS)
    if sheet_name:
        chosen = [s for s in sheets if s.get("name") == sheet_name]
        if not chosen:
            raise ValueError(f"Excel sheet not found: {sheet_name}")
        sheet = chosen[0]
    else:
        if sheet_index < 0 or sheet_index >= len(sheets):
            raise ValueError(f"Excel sheet index is out of range: {sheet_index}")
        sheet = sheets[sheet_index]
    rid = sheet.get(f"{{{NS['r']}}}id")
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall(f"{REL_NS}Relationship") if r.get("Id") == rid)
    path = target.lstrip("/") if target.startswith("/") else "xl/" + target
    data = ET.fromstring(zf.read(path))
    out = []
    for row in data.findall("m:sheetData/m:row", NS):
        rnum = int(row.get("r"))
        cells: dict[int, str] = {}
        for c in row.findall("m:c", NS):
            idx = _col_index(c.get("r"))
            t = c.get("t", "n")
            v = c.find("m:v", NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
            elif t == "str":
                val = v.text if v is not None else None
            elif t == "b" and v is not None:
                val = "true" if v.text == "1" else "false"
            elif t == "e":
                val = None
            elif v is not None and v.text is not None:
                val = _number_text(v.text, int(c.get("s", "0")) in date_styles)
            else:
                val = None
            if val is not None:
                val = val.strip()
                if val:
                    cells[idx] = val
        if cells:
            out.append((rnum, cells))
    return out


def read_xlsx(spark: SparkSession, path: str, props: dict | None = None, has_header: bool = True) -> DataFrame:
    """All-string frame of one sheet of every workbook under ``path``."""
    props = props or {}
    sheet_name = props.get("sheetName")
    sheet_index = int(props.get("sheetIndex", "0"))
    header_idx = max(0, int(props.get("headerRowIndex", "0")))  # 0-based
    if "dataStartRow" in props:
        data_start = max(0, int(props["dataStartRow"]) - 1)
    else:
        data_start = header_idx + 1 if has_header else 0
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers_of(batches):
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = dict(parse_workbook(content, sheet_name, sheet_index))
                hdr = rows.get(header_idx + 1, {})
                width = max([max(r) + 1 for r in rows.values()] or [0])
                yield pd.DataFrame({"path": [p], "cells": [[hdr.get(i) for i in range(width)]]})

    # header from the first workbook only (one small task), not from every file
    first_path = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    head = files.filter(F.col("path") == first_path[0]["path"]) if first_path else files.limit(0)
    first = head.mapInPandas(headers_of, "path string, cells array<string>").collect()
    raw_header = list(first[0]["cells"]) if first else []
    if has_header:
        from sluice.sources.csv import CsvFormat, renames_of

        names = CsvFormat(renames=renames_of(props)).names(raw_header)
    else:
        names = [f"column_{i + 1}" for i in range(len(raw_header))]
    schema = ", ".join(f"`{n}` string" for n in names) + (", " if names else "") + "_row long, _source string"

    def rows_of(batches):
        import pandas as pd

        from sluice.sources.csv import HeaderMismatch

        def last(cells):
            return max((i for i, c in cells.items() if c is not None and str(c).strip()), default=-1)

        known = {i: c for i, c in enumerate(raw_header)}
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                recs = []
                for rnum, cells in parse_workbook(content, sheet_name, sheet_index):
                    if has_header and rnum - 1 == header_idx:
                        own = [cells.get(i) for i in range(last(cells) + 1)]
                        if own != [known.get(i) for i in range(last(known) + 1)]:
                            raise HeaderMismatch(f"{p} has the header {own}, the first workbook {raw_header}")
                    if last(cells) >= len(names):
                        raise HeaderMismatch(f"{p} row {rnum} has more cells than the first workbook has columns")
                    if rnum - 1 < data_start:
                        continue
                    rec = {n: cells.get(i) for i, n in enumerate(names)}
                    rec["_row"] = rnum
                    rec["_source"] = p
                    recs.append(rec)
                yield pd.DataFrame(recs, columns=[*names, "_row", "_source"])

    return files.mapInPandas(rows_of, schema).withColumn("_extracted_at", F.current_timestamp())


def write_xlsx(path: str, sheet: str, rows: list[list], date_cols: set[int] | None = None) -> None:
    """Minimal workbook writer (inline strings, numbers, date cells) used to
    build test inputs; dates are written as serial numbers with a date style."""
    date_cols = date_cols or set()

    def ref(r, c):
        s = ""
        c += 1
        while c:
            c, rem = divmod(c - 1, 26)
            s = chr(65 + rem) + s
        return f"{s}{r}"

    xml_rows = []
    for ri, row in enumerate(rows, start=1):
        cells = []
        for ci, v in enumerate(row):
            if v is None:
                continue
            if isinstance(v, (dt.date, dt.datetime)):
                base = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
                serial = (base - EPOCH_1900).total_seconds() / 86400
                cells.append(f'<c r="{ref(ri, ci)}" s="1"><v>{serial}</v></c>')
            elif isinstance(v, bool):
                cells.append(f'<c r="{ref(ri, ci)}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float, Decimal)):
                cells.append(f'<c r="{ref(ri, ci)}"><v>{v}</v></c>')
            else:
                txt = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                cells.append(f'<c r="{ref(ri, ci)}" t="inlineStr"><is><t>{txt}</t></is></c>')
        xml_rows.append(f'<row r="{ri}">{"".join(cells)}</row>')
    sheet_xml = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>%s</sheetData></worksheet>'
                 % (NS["m"], "".join(xml_rows)))
    wb_xml = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="%s" xmlns:r="%s"><sheets>'
              '<sheet name="%s" sheetId="1" r:id="rId1"/></sheets></workbook>' % (NS["m"], NS["r"], sheet))
    rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>')
    styles = ('<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="%s"><cellXfs count="2">'
              '<xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>' % NS["m"])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", wb_xml)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml)
        z.writestr("xl/styles.xml", styles)
