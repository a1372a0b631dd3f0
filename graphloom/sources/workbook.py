"""Question and answer tables in workbooks (zipped XML sheets)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Names that head the columns of questions and of answers (fixed values).
QUESTION, ANSWER = ("问题", "question"), ("答案", "answer")
#: What XML cannot hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _cells(raw: bytes) -> list[tuple[int, list[str]]]:
    """(row number, cells) of the first sheet; strings may be shared or in place."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/"))))
    rows = []
    for k, row in enumerate(sheet.iter(f"{_NS}row"), 1):
        cells: dict[int, str] = {}
        for c in row.iter(f"{_NS}c"):
            letters = "".join(x for x in c.get("r", "") if x.isalpha()).upper()
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
            value = "".join(x.text or "" for x in c.iter(f"{_NS}t")) or (c.findtext(f"{_NS}v") or "")
            cells[at] = shared[int(value)] if c.get("t") == "s" else value
        rows.append((int(row.get("r", k)), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
    return rows


def question_rows(raw: bytes) -> list[tuple[int, str, str]]:
    """(row number, question, answer): columns by their headings, else the first two; rows without either go."""
    rows = _cells(raw)
    if not rows:
        return []
    head = [c.strip().lower() for c in rows[0][1]]
    ask, say = (next((i for i, c in enumerate(head) if c in names), None) for names in (QUESTION, ANSWER))
    body = rows if ask is None and say is None else rows[1:]
    ask, say = 0 if ask is None else ask, 1 if say is None else say
    cell = lambda r, i: r[i] if i < len(r) else ""
    return [(n, cell(r, ask), cell(r, say)) for n, r in body if cell(r, ask) or cell(r, say)]


def questions(books: DataFrame) -> DataFrame:
    """(source, row_id, question, answer) of workbooks (source, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(s, *r) for s, raw in zip(pdf["source"], pdf["content"], strict=True) for r in question_rows(raw)], columns=["source", "row_id", "question", "answer"])

    return books.select(F.col("source").cast("string").alias("source"), "content").mapInPandas(run, "source string, row_id long, question string, answer string")


def _sheet(head: list[str], rows: list[list[str]]) -> bytes:
    text = lambda x: escape(_BARRED.sub("", x or "")).replace("\r", "&#13;")
    lines = "".join(f'<row r="{k}">' + "".join(f'<c r="{chr(65 + i)}{k}" t="inlineStr"><is><t xml:space="preserve">{text(x)}</t></is></c>' for i, x in enumerate(r)) + "</row>" for k, r in enumerate([head, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def written(rows: DataFrame, source: str, order: str, columns: list[str]) -> DataFrame:
    """(source, content): a workbook for each source, rows in order; a workbook is one row, so a source should fit in one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        return pd.DataFrame({"source": [pdf["s"].iloc[0]], "content": [_sheet(columns, pdf[columns].fillna("").values.tolist())]})

    return rows.select(F.col(source).cast("string").alias("s"), F.col(order).alias("o"), *columns).groupBy("s").applyInPandas(run, "source string, content binary")
