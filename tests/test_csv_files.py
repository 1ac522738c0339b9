"""Quoted CSV files read by many tasks against a character-by-character reader."""

import random

import pytest
from pyspark.sql import functions as F

from accountloom.sources.csv_files import read_csv, read_records


def slow_rows(text, sep=","):
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1:i + 2] == '"':
                cell += '"'
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = True
        elif c == sep:
            row.append(cell)
            cell = ""
        elif c == "\n":
            rows.append([*row, cell])
            row, cell = [], ""
        elif c != "\r":
            cell += c
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return [r for r in rows if any(c.strip() for c in r)]


@pytest.fixture
def small_stretches(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "40"}
    kept = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(rng, rows, sep, end):
    def cell(c):
        return '"' + c.replace('"', '""') + '"' if any(x in c for x in f'{sep}"\n') or rng.random() < 0.2 else c
    return end.join(sep.join(map(cell, r)) for r in rows) + rng.choice(["", end])


@pytest.mark.parametrize("sep,end", [(";", "\r\n"), ("|", "\n")])
def test_many_stretches_equal_one_reader(spark, tmp_path, small_stretches, sep, end):
    rng = random.Random(ord(sep))
    stock = ["a", "b c", 'say ""', '"', "\n", "line\nbreak\n\nmore", sep, "é", "", "", "x" * 90, " pad "]
    rows = [["Name", "Note", " Size "]] + [
        ["".join(rng.choices(stock, k=rng.randrange(0, 4))) for _ in range(rng.choice([1, 2, 3, 3, 3, 4]))] for _ in range(200)]
    path = tmp_path / "export.csv"
    text = written(rng, rows, sep, end)
    path.write_text(text, newline="")
    want = slow_rows(text, sep)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 25
    got = read_csv(spark, str(path), sep=sep)
    assert got.columns == ["Name", "Note", "Size"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple((r + ["", "", ""])[:3]) for r in want[1:])


def test_records_keep_their_order(spark, tmp_path, small_stretches):
    path = tmp_path / "o.csv"
    path.write_text("h\n" + "".join(f'{i},"a\n{i}"\n' if i % 3 else f"{i},b\n" for i in range(200)))
    rows = [r["record"] for r in read_records(spark, str(path)).orderBy("at").collect()]
    assert [r.split(",")[0] for r in rows] == ["h", *map(str, range(200))]


def test_break_inside_a_cell_on_every_border(spark, tmp_path, small_stretches):
    """One record of line breaks only, far longer than a stretch, between plain ones."""
    path = tmp_path / "b.csv"
    path.write_text('k,v\n1,x\n2,"' + "\n" * 1000 + '"\n3,y\n4,"never closed\n5,z\n')
    got = {r["k"]: r["v"] for r in read_csv(spark, str(path), sep=",").collect()}
    assert got == {"1": "x", "2": "\n" * 1000, "3": "y", "4": "never closed\n5,z"}


def test_cells_as_the_reader_takes_them(spark, tmp_path):
    path = tmp_path / "c.csv"
    text = 'a,b,c\n,,x\n"""",ab"c,d"e,""\n"q""r",,\n x ,"",y\n'
    path.write_text(text)
    got = [tuple(r) for r in read_csv(spark, str(path), sep=",").collect()]
    assert sorted(got) == sorted(tuple(r) for r in slow_rows(text)[1:])


def test_titles_above_the_header_and_no_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Export of May\n\nName;Owner\nA;x\nB\n")
    rows = read_csv(spark, str(path), sep=";", header_words=("name", "owner", "size"))
    assert sorted(map(tuple, rows.collect())) == [("A", "x"), ("B", "")]
    (tmp_path / "e.csv").write_text("\n \n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "e.csv"), sep=",")
