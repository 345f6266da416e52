"""Text, delimited and fixed-width files, file listings and versioned tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field

#: Encodings in the order in which they are tried; the last cannot fail.
ENCODINGS = ["utf-8", "cp1252", "latin-1"]
_CHARSETS = {"utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}


def _encoding_of(raw: bytes, names: list[str] = ENCODINGS) -> str | None:
    """The first encoding that reads all bytes strictly."""
    import codecs

    for name in names:
        decoder, view = codecs.getincrementaldecoder(name)(), memoryview(raw)
        try:
            for k in range(0, len(view), 1 << 20):
                decoder.decode(view[k : k + (1 << 20)])
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            continue
        return name
    return None


def encodings(spark: SparkSession, path: str, names: list[str] = ENCODINGS) -> DataFrame:
    """(path, encoding): the first strict decoding of each whole file (S-01, S-02). Files come through Spark's
    reader, one a row; above two gigabytes give the encoding instead."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "encoding": [_encoding_of(raw, names) for raw in pdf["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, encoding string")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, header: bool = True) -> DataFrame:
    """A delimited file as text columns and ``ord``, its rows' order (S-01 to S-03, S-19).

    Quoted fields may hold separators, doubled quotes and line ends; short rows are padded, long ones cut; a byte
    order mark is dropped; of headers that differ in case only the first keeps its name, later ones get their position.
    """
    if encoding is None:
        found = [r["encoding"] for r in encodings(spark, path).select("encoding").distinct().collect()]  # at most one of each name
        if len(found) > 1:  # a folder of several encodings: each file by its own
            return _decoded_rows(spark, path, sep, None, header)
        encoding = found[0] if found else "utf-8"
    if encoding == "cp1252":  # Spark's reader takes no such charset
        return _decoded_rows(spark, path, sep, encoding, header)

    def reader():
        return (
            spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", "true").option("mode", "PERMISSIVE").option("encoding", _CHARSETS.get(encoding, encoding))
        )

    # Read by position: the names of the file may clash without regard to case.
    before = spark.conf.get("spark.sql.caseSensitive", None)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        found = reader().csv(path).columns
    finally:
        spark.conf.unset("spark.sql.caseSensitive") if before is None else spark.conf.set("spark.sql.caseSensitive", before)
    df = reader().schema(", ".join(f"_{k} string" for k in range(len(found)))).csv(path)
    return df.toDF(*_apart(found)).withColumn("ord", F.monotonically_increasing_id())


def _apart(found: list[str]) -> list[str]:
    names: list[str] = []
    for k, n in enumerate(n.lstrip("\ufeff") for n in found):
        names.append(f"{n}__{k}" if n.upper() in {x.upper() for x in names} else n)
    return names


def _decoded_rows(spark: SparkSession, path: str, sep: str, encoding: str | None, header: bool) -> DataFrame:
    """The same decoded in Python, each file by its own encoding if none is given; one file is one task."""

    def run(batches):
        import csv
        import io
        from itertools import batched

        import pandas as pd

        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                rows = csv.reader(io.TextIOWrapper(io.BytesIO(raw), encoding or _encoding_of(raw), newline=""), delimiter=sep)
                for part in batched(enumerate(r for r in rows if r), 10000):
                    yield pd.DataFrame({"file": [file] * len(part), "k": [k for k, _ in part], "cells": [r for _, r in part]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInPandas(run, "file string, k long, cells array<string>")
    first = rows.filter("k = 0").groupBy().agg(F.min_by("cells", "file").alias("cells")).first()["cells"]
    names = _apart(first) if header and first else [f"_c{k}" for k in range(len(first or []))]
    cells = [F.nullif(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)]
    body = rows.filter("k > 0") if header else rows
    return body.select(*cells).withColumn("ord", F.monotonically_increasing_id())


def delimiter_of(path: str, header_line: str) -> str:
    """Comma or tab by the file's ending, else by which the header has more of."""
    if path.lower().endswith(".csv"):
        return ","
    if path.lower().endswith((".tsv", ".tab")):
        return "\t"
    return "\t" if header_line.count("\t") > header_line.count(",") else ","


def fixed_width(lines: DataFrame, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns of 1-based inclusive positions of ``value``; blank lines go (S-05, F-33)."""
    some = lines.filter(F.trim("value") != "")
    kept = [c for c in lines.columns if c != "value"]
    cut = lambda a, b: F.regexp_replace(F.substring("value", a, b - a + 1), r"\s+$", "")
    return some.select(*kept, *[cut(a, b).alias(name) for name, (a, b) in fields.items()])


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, value): the lines of text files in order. One file is one row before it is split, as its
    lines have an order."""
    if encoding.upper() == "UTF-8":
        whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
        )
    else:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
            F.col("path").alias("file"), F.decode("content", encoding).alias("text")
        )
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    text = F.regexp_replace(text, "\n$", "")
    return whole.select("file", F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


# ---- Fixed values: positions of the property and improvement exports ----
PROPERTY_FIELDS = {
    "prop_id": (1, 12), "situs_prefix": (1040, 1049), "situs_street": (1050, 1099), "situs_suffix": (1100, 1109),
    "situs_city": (1110, 1139), "situs_zip": (1140, 1149), "situs_num": (4460, 4474), "situs_unit": (4475, 4479),
}
OWNER_LAYOUTS = [
    {"line1": (694, 753), "line2": (754, 813), "line3": (814, 873), "city": (874, 923)},
    {"line1": (2273, 2332), "line2": (2333, 2392), "line3": (2393, 2452), "city": (2453, 2502)},
]
IMPROVEMENT_FIELDS = {"prop_id": (1, 12), "type_cd": (29, 38), "type_desc": (39, 63), "state_cd": (64, 68)}
# ---- End of fixed values ----


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """The property export with blank situs cities filled from owner addresses (D16, F-34); the last row of an id wins."""
    from ..operators.dedup import last_wins
    from ..operators.property import back_filled_city

    owner = {f"o{k}_{n}": at for k, layout in enumerate(OWNER_LAYOUTS) for n, at in layout.items()}
    rows = fixed_width(read_lines(spark, path, "ISO-8859-1"), PROPERTY_FIELDS | owner)
    layouts = [([F.col(f"o{k}_line{n}") for n in (1, 2, 3)], F.col(f"o{k}_city")) for k in range(len(OWNER_LAYOUTS))]
    city = back_filled_city("situs_city", "situs_num", "situs_prefix", "situs_street", "situs_suffix", layouts)
    cols = [field(c).alias(c) if c != "situs_city" else city.alias(c) for c in PROPERTY_FIELDS]
    return last_wins(rows.select("line_no", *cols), ["prop_id"], "line_no").drop("line_no")


def read_improvements(spark: SparkSession, path: str) -> DataFrame:
    """The improvement export in file order (D17)."""
    rows = fixed_width(read_lines(spark, path, "ISO-8859-1"), IMPROVEMENT_FIELDS)
    return rows.select(F.col("line_no").cast("long").alias("ord"), *[field(c).alias(c) for c in IMPROVEMENT_FIELDS])


def file_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, length) of files below a folder whose name matches, without temporary ones (S-12)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"
    )
    return files.filter(F.col("name").rlike(pattern) & ~F.col("name").startswith("~"))


def companions(files: DataFrame, one: str = "c", two: str = "i", ending: str = "pdf") -> DataFrame:
    """(path, companion): ``NNNc.pdf`` beside ``NNNi.pdf`` of the same folder, blank without (S-13)."""
    at = rf"^(.*/[0-9]+){{}}\.{ending}$"
    stem = lambda s: F.regexp_extract("path", at.format(s), 1)
    a = files.select("path", stem(one).alias("stem")).filter("stem != ''")
    b = files.select(F.col("path").alias("companion"), stem(two).alias("stem")).filter("stem != ''")
    return a.join(b, "stem", "left").select("path", F.coalesce("companion", F.lit("")).alias("companion"))


def roster_name_parts(name: Column) -> dict[str, Column]:
    """Ballot type and date of a roster's file name (S-14); the date is null without three parts (V-12)."""
    low = F.lower(name)
    prov, limited = F.contains(low, F.lit("provisional")), F.contains(low, F.lit("limited"))
    kind = (
        F.when(prov, "PROV").when(limited, "LTD").when(F.contains(low, F.lit("mail")), "BBM")
        .when(F.contains(low, F.lit("early")), "EV").otherwise("ED")
    )
    day = F.split(F.get(F.split(name, " "), F.lit(0)), r"\.")
    return {"ballot_type": kind, "vote_date": F.when(F.size(day) == 3, F.concat_ws("/", day))}


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """A table with its version as a column (K-13, D22)."""
    df.withColumn("__version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table, if it has the expected version; else an error (S-18)."""
    df = spark.read.parquet(path)
    if "__version" not in df.columns:
        raise ValueError(f"{path} has no version")
    other = df.filter(F.col("__version") != version).select("__version").limit(1).collect()
    if other:
        raise ValueError(f"{path} has version {other[0][0]}, not {version}")
    return df.drop("__version")


def decoded_files(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows that ``decode(path, bytes)`` yields for each file: the place for PDF text, barcode and image readers
    (S-15 to S-17). One file is one task row; without a reader library use text exports and ``read_lines``."""

    def run(batches):
        import pandas as pd

        names = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema)]
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                rows = list(decode(file, bytes(raw)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def routed_barcodes(codes: DataFrame) -> DataFrame:
    """(file, style_code, header_code, barcodes) of decoded codes by their length: 28, 8 and 6 digits, the last in
    reverse scan order (S-16, D8)."""
    n = F.length("code")
    pick = lambda size: F.max(F.when(n == size, F.col("code")))
    six = F.filter(F.collect_list(F.when(n == 6, F.struct(-F.col("ord"), "code"))), lambda x: x.isNotNull())
    return codes.groupBy("file").agg(
        pick(28).alias("style_code"), pick(8).alias("header_code"), F.transform(F.array_sort(six), lambda x: x["code"]).alias("barcodes")
    )
