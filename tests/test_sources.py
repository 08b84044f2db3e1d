"""Text tables of any separator, exports of several sheets, appended rows, and files of a folder."""

import os

import pytest

from tallybook import sources


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_upload_of_any_separator(spark, tmp_path, sep):
    rows = [["Ref ", "Na;me,", "Stock"], ["A1", f"x {sep} y", "3"], ["B2", 'say "no"', ""], ["C3", "two\nlines", "5"], ["Ä4", "", "7"]]
    cell = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in (sep, '"', "\n")) else c
    path = tmp_path / "up.csv"
    path.write_text("﻿" + "\n".join(sep.join(map(cell, r)) for r in rows) + "\n", encoding="utf-8")
    got = sources.read_table(spark, str(path))
    assert got.columns == ["Ref", "Na;me,", "Stock"]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(c or None for c in r) for r in rows[1:])


def test_separator_of_odd_files(spark, tmp_path):
    cases = {"none.csv": "alone\n1\n", "more.csv": "a;b,c;d\n1;2,3;4\n", "late.csv": "a;b\n" + "x;y\n" * 3000 + "," * 20_000}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    assert [sources.separator(spark, str(tmp_path / n)) for n in cases] == [",", ";", ";"]


def test_sheets_come_back(spark, tmp_path):
    header = spark.createDataFrame([(1, "=SUM(A1)"), (2, "plain")], "doc int, note string")
    positions = spark.createDataFrame([(1, 'a "b", c', 1.5), (1, "line\nend", None), (2, None, 2.0)], "doc int, name string, net double")
    sources.write_sheets({"header": header, "positions": positions}, str(tmp_path))
    assert sorted(map(tuple, sources.read_sheet(spark, str(tmp_path), "header").collect())) == [("1", "'=SUM(A1)"), ("2", "plain")]
    assert set(map(tuple, sources.read_sheet(spark, str(tmp_path), "positions").collect())) == {("1", 'a "b", c', "1.5"), ("1", "line\nend", None), ("2", None, "2.0")}


def test_rows_are_appended(spark, tmp_path):
    for k in range(3):
        sources.append_rows(spark.range(k, k + 2), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1, 1, 2, 2, 3]


def test_files_below_a_folder(spark, tmp_path):
    for name in ("a.pdf", "sub/b.pdf", "sub/deep er/c.pdf", "sub/d.txt"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    got = sources.file_entries(spark, str(tmp_path))
    assert sorted((r.rel_path, r.name, r.size) for r in got.collect()) == [("a.pdf", "a.pdf", 5), ("sub/b.pdf", "b.pdf", 9), ("sub/deep er/c.pdf", "c.pdf", 17)]
    assert all(r.mtime is not None for r in got.collect())


def test_separator_is_found_without_reading_whole_files(spark, tmp_path):
    """Files over the length that may be read whole; the first that is not empty tells, by its first characters."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("")
    (tmp_path / "t" / "b.csv").write_text("ą;b\n" + "ą;1\n" * 4000 + "," * 90_000)
    (tmp_path / "t" / "c.csv").write_text("ą,b\n" + "1,2\n" * 4000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert sources.separator(spark, str(tmp_path / "t")) == ";" and sources.separator(spark, str(tmp_path / "t" / "c.csv")) == ","
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
