"""Spreadsheets and chat exports (SRC-02, SRC-03): one file for each task, read by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_rows(content: bytes, sheet: str, align: str = "positional") -> list[dict[str, str]]:
    """Rows of one sheet by head. ``positional``: a missing cell shifts later values left; ``column``: values keep their column."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name))
        links = {r.attrib["Id"]: r.attrib["Target"].lstrip("/").removeprefix("xl/") for r in part("xl/_rels/workbook.xml.rels")}
        sheets = {s.attrib["name"]: links[s.attrib[f"{_REL}id"]] for s in part("xl/workbook.xml").iter(f"{_MAIN}sheet")}
        if sheet not in sheets:
            raise KeyError(f"no sheet {sheet!r}; there are {sorted(sheets)}")
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
        shared = [text(s) for s in part("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        table = []
        for row in part(f"xl/{sheets[sheet]}").iter(f"{_MAIN}row"):
            cells = {}
            for c in row.iter(f"{_MAIN}c"):
                value = c.findtext(f"{_MAIN}v")
                if value is None and (inline := c.find(f"{_MAIN}is")) is not None:
                    value = text(inline)
                elif c.attrib.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                cells[re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]] = (value or "").strip()
            if any(cells.values()):
                table.append(cells)
    if not table:
        return []
    head = table[0]
    if align == "column":
        return [{head[k]: v for k, v in r.items() if head.get(k)} for r in table[1:]]
    return [dict(zip(head.values(), r.values(), strict=False)) for r in table[1:]]


def read_xlsx(spark: SparkSession, path: str, sheet: str, *, align: str = "positional") -> DataFrame:
    """SRC-02: source_file, row_no, cells (map of head to text) of every workbook under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = sheet_rows(bytes(content), sheet, align)
                if rows:
                    yield pd.DataFrame({"source_file": name, "row_no": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, row_no long, cells map<string,string>")


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: source_file, html of every page under a folder, or in the archives there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for member in sorted(m for m in z.namelist() if m.lower().endswith(".html")):
                            yield pd.DataFrame({"source_file": [f"{name}!{member}"], "html": [z.read(member).decode("utf-8", "replace")]})
                else:
                    yield pd.DataFrame({"source_file": [name], "html": [bytes(content).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,zip}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, html string")
