"""Files made here, read back."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from ballotbook.functions.text import zip_split
from ballotbook.operators import checks, ordered, tally, viewer
from ballotbook.sources import files, headers, reports, sinks, workbooks
from ballotbook.streaming import rosters


@pytest.mark.parametrize("encoding,text", [("utf-8", "É"), ("utf-8-sig", "É"), ("cp1252", "’É"), ("latin-1", "\x81É")])
def test_delimited_encodings(spark, tmp_path, encoding, text):
    raw = f'VUID,City,Note,CITY\n1,{text},"a ""q"", b\nc",9\n2,short\n3,x,y,z,extra\n'
    (tmp_path / "a.csv").write_bytes(raw.encode(encoding))
    df = files.read_delimited(spark, str(tmp_path))
    rows = df.orderBy("ord").collect()
    assert df.columns[0] == "VUID" and len(rows) == 3 and rows[0][1] == text
    assert rows[0][2] == 'a "q", b\nc'
    roles = headers.by_roles(df).orderBy("ord").collect()
    assert [r["vuid"] for r in roles] == ["1", "2", "3"] and roles[0]["city"] == text and roles[1]["last"] == ""
    with pytest.raises(ValueError):
        headers.require(df, headers.ROLES["precinct"])


def test_fixed_width_properties(spark, tmp_path):
    line = [" "] * 4500

    def put(a, text):
        line[a - 1 : a - 1 + len(text)] = text

    put(1, "000000000042")
    put(1050, "LAMAR")
    put(1100, "BLVD")
    put(4460, "12")
    put(2273, "12 LAMAR BLVD #4")
    put(2453, "KYLE")
    (tmp_path / "PROP.TXT").write_text("".join(line) + "\r\n\r\n", encoding="latin-1")
    row = files.read_properties(spark, str(tmp_path / "PROP.TXT")).first()
    assert (row["prop_id"], row["situs_city"], row["situs_num"]) == ("000000000042", "KYLE", "12")


def test_lists_companions_and_names(spark, tmp_path):
    for name in ("001c.pdf", "001i.pdf", "002c.pdf", "~003c.pdf", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.companions(files.file_list(spark, str(tmp_path), r"\.pdf$")).collect()
    assert sorted((r["path"][-8:], r["companion"][-8:]) for r in found) == [("001c.pdf", "001i.pdf"), ("002c.pdf", "")]
    parts = files.roster_name_parts(F.lit("03.02.2026 Early Voting.xlsx"))
    assert [spark.range(1).select(c).first()[0] for c in parts.values()] == ["EV", "03/02/2026"]
    bad = files.roster_name_parts(F.lit("March Mail.xlsx"))
    assert [spark.range(1).select(c).first()[0] for c in bad.values()] == ["BBM", None]


def test_versions(spark, tmp_path):
    files.write_versioned(spark.range(3).toDF("a"), str(tmp_path / "t"), 2)
    assert files.read_versioned(spark, str(tmp_path / "t"), 2).count() == 3
    with pytest.raises(ValueError):
        files.read_versioned(spark, str(tmp_path / "t"), 3)


def workbook(path, sheets):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            body = ""
            for n, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>'
                    for i, v in enumerate(row) if v is not None
                )
                body += f'<row r="{n}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    fixed = [["title"], [], ["VUID", "Pct", "First", "Last"], [10.0, "101", "Ann", "Lee"], [11, None, "No", "Precinct"], [12, "102", "nan", "Poe"]]
    workbook(tmp_path / "03.02.2026 Mail.xlsx", {"REP list": fixed, "DEM list": fixed})
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    out = workbooks.roster_fixed(rows, 3, ["vuid", "precinct", "first", "last"], party_from_sheet=True).collect()
    assert sorted((r["vuid"], r["precinct"], r["first"], r["last"], r["party"], r["ballot_type"]) for r in out) == [
        ("10", "101", "Ann", "Lee", "DEM", "BBM"), ("10", "101", "Ann", "Lee", "REP", "BBM"), ("12", "102", "", "Poe", "DEM", "BBM"), ("12", "102", "", "Poe", "REP", "BBM"),
    ]
    other = tmp_path / "b"
    other.mkdir()
    workbook(other / "05.02.2026 list.xlsx", {"One": [["x"], ["Pct", "Voter VUID", "Voter Name", "Note"], ["7", 5, "Doe, Jane Q", "hm"]]})
    r = workbooks.roster_detected(workbooks.read_workbooks(spark, str(other))).first()
    assert (r["vuid"], r["precinct"], r["first"], r["last"], r["notes"], r["ballot_type"]) == ("5", "7", "Jane", "Doe", "hm", "ED")
    rid = tmp_path / "c"
    rid.mkdir()
    workbook(rid / "d.xlsx", {"One": [["State Voter ID", "First Name", "Last", "RID Reason", "Location"], [9, "A", "B", "lost", "Hall"]]})
    r = workbooks.declarations(workbooks.read_workbooks(spark, str(rid))).first()
    assert (r["vuid"], r["reason"], r["location"], r["middle"]) == ("9", "lost", "Hall", "")


def test_listing(spark):
    rows = [
        ["Ballot Detail Listing"], ["info"], ["info"], ["Ballot Style D 12"], ["Order", "Contest"], ["1", "Mayor"], ["Ballot Style R 13"], ["2", "Judge"],
        ["Ballot Detail Listing"], ["info"], ["Order", "Contest"], ["3", "Clerk"], ["Ballot Detail Listing"], ["no header"],
    ]
    df = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "file string, line_no int, cells array<string>")
    out = reports.ballot_listing(df, ["order", "contest"]).orderBy("line_no").collect()
    assert [(r["ballot_type"], r["style"], r["order"], r["contest"]) for r in out] == [("D", "12", "1", "Mayor"), ("R", "13", "2", "Judge"), ("R", "13", "3", "Clerk")]
    assert [r["page_no"] for r in reports.pages_without_header(df).collect()] == [3]


def test_cast_vote_records(spark):
    text = ["Precinct: 12", "", "Contests", "Mayor of a", "Vote For: 2", "Ann", "Lee (12)", "Counted", "Bob (13)", "Overvoted", "Judge (7)", "Vote For: 1", "Undervote (0)", "Undervoted"]
    lines = spark.createDataFrame([("b1", k, t) for k, t in enumerate(text)], "file string, line_no int, line string")
    out = reports.cast_vote_records(lines).orderBy("ord").collect()
    assert [(r["contest"], r["vote_for"], r["selection"], r["status"]) for r in out] == [
        ("Mayor of a", 2, "Ann Lee", "Counted"), ("Mayor of a", 2, "Bob", "Overvoted"), ("Judge", 1, "Undervote", "Undervoted"),
    ]
    assert checks.contest_shape(lines).count() == 0
    single = {(r["contest"], r["selection"]): r["n"] for r in tally.tally_single(reports.cast_vote_records(lines)).collect()}
    assert single[("Judge", "Undervote")] == 1


def test_tapes_keep_last_values_and_drop_open_ends(spark):
    text = ["Serial Number: 1", "Public Count: 5", "Smith 3", "END OF REPORT", "Public Count: 8", "END OF REPORT: no", "end", "END OF REPORT", "Smith 1"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line_no int, line string")
    out = ordered.tape_segments(lines, ["Smith"]).orderBy("tape").collect()
    assert [(r["serial"], r["public_count"], r["Smith"]) for r in out] == [("1", 5, 3), (None, 8, None)]


def test_viewer(spark, tmp_path):
    df = spark.createDataFrame([("7", "Doe", "Jane", "12", "N", "Elm", "ST", "Austin", "787011234"), ("8", "Poe", "Al", "3", "", "Oak", "", "Kyle", "78640")], "VUIDNO string, LSTNAM string, FSTNAM string, BLKNUM string, STRPRE string, STRNAM string, STRTYP string, RSCITY string, RZIPCD string")
    out = viewer.display(df)
    assert len(out.columns) == len(df.columns) + 3
    rows = out.collect()
    assert (rows[0]["Voter ID"], rows[0]["Name"], rows[0]["Address"]) == ("7", "Doe, Jane", "12 N Elm ST, Austin, 78701-1234")
    assert rows[1]["Address"] == "3 Oak, Kyle, 78640"
    line = out.select(viewer.copy_text(out, ["Voter ID", "Name", "Address"]).alias("line")).first()["line"]
    assert line == '7,"Doe, Jane","12 N Elm ST, Austin, 78701-1234"'
    wide = spark.createDataFrame([tuple("x" for _ in range(400))], ["VUIDNO", "LSTNAM", "FSTNAM", *[f"H{k}" for k in range(3, 400)]])
    assert len(viewer.display(wide).columns) == 403
    with pytest.raises(ValueError):
        viewer.display(spark.createDataFrame([tuple("x" for _ in range(1022))], [f"c{k}" for k in range(1022)]))
    page = viewer.page(viewer.sorted_view(df.withColumn("row_id", F.lit(0)), "LSTNAM", True), 1, 1).collect()
    assert page[0]["LSTNAM"] == "Doe"
    assert viewer.roles(["idnumber", "StrDir", "STRPRE"]) == {"other_id": "idnumber", "direction": "StrDir", "predir": "STRPRE", "vuid": "idnumber", "postdir": "StrDir"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "b", 'q"x'), ("1", "A", ""), ("2", "c", "z")], "precinct string, last string, note string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["last", "note"], ["last"], one_file=True)
    text = next((tmp_path / "csv").glob("part*")).read_text()
    assert text == 'last,note\nA,\nb,"q""x"\nc,z\n'
    sinks.write_by_value(df, str(tmp_path / "by"), "precinct", ["last"])
    assert sorted(p.name for p in (tmp_path / "by").glob("precinct=*")) == ["precinct=1", "precinct=2"]
    sinks.write_text(df.select(F.col("last").alias("line")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 3


def test_more_checks(spark):
    codes = spark.createDataFrame([("1" * 28,), ("1" * 7,), (None,)], "code string")
    assert checks.barcode_lengths(codes).count() == 2
    rows = spark.createDataFrame([("RD__~~~~",), ("RX______",), ("R~XXXXXX",)], "history string")
    assert [r["history"] for r in checks.history_letters(rows).collect()] == ["RX______"]
    names = spark.createDataFrame([("03.02.2026 a.xlsx",), ("March a.xlsx",)], "name string")
    assert checks.file_dates(names).count() == 1
    ballots = spark.createDataFrame([(1, ["a"], 2, "1" * 28), (2, [], 5, None), (3, ["a"], 1, "12")], "ballot int, barcodes array<string>, n_counted int, style_code string")
    assert [r["ballot"] for r in checks.barcode_counts(ballots).collect()] == [1]
    assert [r["ballot"] for r in checks.style_codes(ballots).collect()] == [3]
    nested = spark.createDataFrame([(1, [([("a", "Counted"), ("b", "Overvoted")],), ([("c", "Counted")],)])], "ballot int, contests array<struct<selections:array<struct<selection:string,status:string>>>>")
    assert tally.counted_per_ballot(nested).first()["n_counted"] == 2
    codes = spark.createDataFrame([("f", 1, "1" * 28), ("f", 2, "000001"), ("f", 3, "000002")], "file string, ord int, code string")
    assert files.routed_barcodes(codes).first()["barcodes"] == ["000002", "000001"]


def test_streams(spark, tmp_path):
    from datetime import datetime

    schema = "vuid string, ord long, ballot_type string, ts timestamp"
    src = tmp_path / "in"
    spark.createDataFrame([("1", 1, "EV", datetime(2026, 3, 1)), ("2", 2, "ED", datetime(2026, 3, 2))], schema).coalesce(1).write.parquet(str(src))
    spark.createDataFrame([("1", 3, "BBM", datetime(2026, 3, 2))], schema).coalesce(1).write.mode("append").parquet(str(src))
    rows = rosters.roster_stream(spark, str(src), schema)
    rosters.upsert_into(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(sorted((tmp_path / "out").glob("v=*"))[-1]))
    assert {r["vuid"]: r["ballot_type"] for r in found.collect()} == {"1": "BBM", "2": "ED"}
    q = rosters.first_rows(rosters.roster_stream(spark, str(src), schema)).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    q = rosters.daily_counts(rosters.roster_stream(spark, str(src), schema)).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == 3


def test_zip_cases(spark):
    rows = [("787011234", "", "1234"), ("78701", "0000", ""), ("78701", "0042", "0042"), ("78701-0000", "", ""), ("", "12", "12"), ("78701", "", "")]
    for z, four, expected in rows:
        assert spark.range(1).select(zip_split(F.lit(z), F.lit(four))[1]).first()[0] == expected


def test_files_of_several_encodings_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("VUID,NAME\n1,Müller €\n".encode())
    (tmp_path / "b.csv").write_bytes("VUID,NAME\n2,Müller €\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("\ufeffVUID,NAME\n3,plain\n".encode())
    got = {r["VUID"]: r["NAME"] for r in files.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {"1": "Müller €", "2": "Müller €", "3": "plain"}


def test_rows_are_numbered_without_gaps(spark):
    from ballotbook.operators.dedup import number_rows

    rows = spark.range(3_000_000).select((F.xxhash64("id") % 1_000_000).alias("k"), "id", F.lit("some width to split " * 4).alias("pad"))
    one = number_rows(rows, ["k", "id"], ("k",)).agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(one) == (3_000_000, 3_000_000, 1, 3_000_000)


def test_descending_order_of_prefixes_digits_and_accents(spark):
    from ballotbook.operators.viewer import numbered_view

    names = ["ab", "abc", "Äb", "a1", "a10", "", None, "AB"]
    rows = spark.createDataFrame(list(enumerate(names)), "row_id long, name string")
    got = [r["name"] for r in numbered_view(rows, "name", descending=True).orderBy("position").collect()]
    assert got == ["Äb", "abc", "ab", "AB", "a10", "a1", "", None]
