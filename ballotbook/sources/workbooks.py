"""Roster workbooks (.xlsx: zipped XML) as a data source, and their layouts as DataFrames.

``spark.read.format("workbook").load(folder)`` gives file, sheet, row_no (from 1) and cells, an array of texts.
One workbook is one partition.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import first_of_combined, last_of_combined, nan_to_empty
from .files import roster_name_parts

SCHEMA = "file string, sheet string, row_no int, cells array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """``C7`` -> 2."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; numbers lose a needless ``.0``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet in book.find("m:sheets", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            for row in ElementTree.fromstring(z.read(path)).iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall("m:c", _NS)):
                    at = column_number(c.get("r")) if c.get("r") else k
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is None or v.text is None:
                        text = ""
                    elif c.get("t") == "s":
                        text = shared[int(v.text)]
                    else:
                        text = re.sub(r"\.0+$", "", v.text)
                    cells[at] = text
                width = max(cells, default=-1) + 1
                yield sheet.get("name"), int(row.get("r")), [cells.get(k, "") for k in range(width)]


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.root = path

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_Book(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".xlsx") and not f.base_name.startswith("~")]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as f:
            raw = f.read()
        for sheet, row, cells in sheet_rows(raw):
            yield partition.path, sheet, row, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of the workbooks below a folder (S-06 to S-12)."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


def _cell(k: int):
    return nan_to_empty(F.get("cells", F.lit(k)))


def roster_fixed(rows: DataFrame, header_row: int, columns: list[str], party_from_sheet: bool = False) -> DataFrame:
    """A layout of fixed columns below a header row (S-07 to S-09). ``columns``: vuid, precinct, first, last, name
    (``Last, First``) or notes, in order."""
    some = rows.filter(F.col("row_no") > header_row)
    cols = {c: _cell(k) for k, c in enumerate(columns)}
    return _roster(some, cols, party_from_sheet)


def roster_detected(rows: DataFrame, party_from_sheet: bool = False, within: int = 10) -> DataFrame:
    """A layout found by header words in the first rows of each sheet, else columns in the usual order (S-06, S-10).

    A header row names an id and a precinct; name columns are first and last, or one ``Last, First``.
    """
    low = F.transform("cells", lambda x: F.lower(F.coalesce(x, F.lit(""))))
    at = lambda word: F.array_position(F.transform(low, lambda x: F.contains(x, F.lit(word))), True) - 1
    marks = rows.filter(F.col("row_no") <= within).select(
        "file", "sheet", "row_no", at("vuid").alias("vuid"), F.greatest(at("precinct"), at("pct")).alias("precinct"),
        at("first").alias("first"), at("last").alias("last"), at("name").alias("name"), at("note").alias("notes"),
    ).filter("vuid >= 0 and precinct >= 0")
    names = ["vuid", "precinct", "first", "last", "name", "notes"]
    heads = marks.groupBy("file", "sheet").agg(F.min_by(F.struct("row_no", *names), "row_no").alias("h"))
    joined = rows.join(heads, ["file", "sheet"], "left").filter(F.col("row_no") > F.coalesce("h.row_no", F.lit(2)))
    usual = {"vuid": 0, "precinct": 1, "first": 2, "last": 3, "name": -1, "notes": 4}
    pick = lambda c: nan_to_empty(F.get("cells", F.when(F.coalesce(F.col(f"h.{c}"), F.lit(usual[c])) >= 0, F.coalesce(F.col(f"h.{c}"), F.lit(usual[c])).cast("int"))))
    split = (F.coalesce(F.col("h.first"), F.lit(2)) >= 0) & (F.coalesce(F.col("h.last"), F.lit(3)) >= 0)
    cols = {
        "vuid": pick("vuid"), "precinct": pick("precinct"), "notes": pick("notes"),
        "first": F.when(split, pick("first")).otherwise(first_of_combined(pick("name"))),
        "last": F.when(split, pick("last")).otherwise(last_of_combined(pick("name"))),
    }
    return _roster(joined, cols, party_from_sheet)


def _roster(rows: DataFrame, cols: dict, party_from_sheet: bool) -> DataFrame:
    """The canonical roster rows (D2) that have a precinct and a name (P-07), with file order."""
    cols = dict(cols)
    if "name" in cols:
        name = cols.pop("name")
        cols |= {"first": first_of_combined(name), "last": last_of_combined(name)}
    parts = roster_name_parts(F.element_at(F.split("file", "/"), -1))
    low = F.lower("sheet")
    party = F.when(F.contains(low, F.lit("rep")), "REP").when(F.contains(low, F.lit("dem")), "DEM") if party_from_sheet else F.lit(None).cast("string")
    blank = F.lit("")
    out = rows.select(
        F.struct("file", "sheet", "row_no").alias("ord"), *[cols.get(c, blank).alias(c) for c in ("vuid", "precinct", "first", "last", "notes")],
        party.alias("party"), *[c.alias(n) for n, c in parts.items()],
    )
    return out.filter("precinct != '' and (first != '' or last != '')")


def declarations(rows: DataFrame, reason_words: list[str] = ["reason"], within: int = 10) -> DataFrame:
    """Declaration workbooks: id, names, reason, id type, location and date by header words (S-11, D21)."""
    low = F.transform("cells", lambda x: F.lower(F.coalesce(x, F.lit(""))))

    def at(*words):
        hit = F.transform(low, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)))
        return F.array_position(hit, True) - 1

    wanted = {"vuid": ["voter id", "vuid"], "first": ["first"], "last": ["last"], "middle": ["middle"], "reason": reason_words, "id_type": ["id type"], "location": ["location"], "vote_date": ["date"]}
    marks = rows.filter(F.col("row_no") <= within).select("file", "sheet", "row_no", *[at(*w).alias(c) for c, w in wanted.items()])
    heads = marks.filter("vuid >= 0 and reason >= 0").groupBy("file", "sheet").agg(F.min_by(F.struct("row_no", *wanted), "row_no").alias("h"))
    joined = rows.join(heads, ["file", "sheet"]).filter(F.col("row_no") > F.col("h.row_no"))
    cell = lambda c: nan_to_empty(F.get("cells", F.when(F.col(f"h.{c}") >= 0, F.col(f"h.{c}").cast("int")))).alias(c)
    w = Window.partitionBy("file").orderBy("sheet", "row_no")
    return joined.select(F.row_number().over(w).alias("ord"), *[cell(c) for c in wanted]).filter("vuid != ''")
