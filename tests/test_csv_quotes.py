"""Quoted line breaks, bare quotes, encodings and widths of the splittable CSV reader."""

import csv
import io
import os
import random

import pytest

from sluice.plans.config import SourceConfig
from sluice.sources import csv as src


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return path


def rows_of(df):
    names = [c for c in df.columns if not c.startswith("_")]
    return [(r["_row"], *[r[n] for n in names]) for r in df.orderBy("_source", "_row").collect()]


def expected(text, sep=","):
    """Records by a reader of the whole file: first line's number, cells (null for empty)."""
    out, at = [], 1
    for record in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
        lines = 1 + sum(c.count("\n") for c in record)
        out.append((at, [c if c != "" else None for c in record]))
        at += lines
    return out


def made(seed, n):
    rng = random.Random(seed)
    out = ["id,a,b,c"]
    for i in range(n):
        cells = [str(i)]
        for _ in range(3):
            x = rng.choice(["plain", 'say ""hi""', "two\nlines", "a\n\n\nb", 'x"\nstill', "comma, inside", "", "a" * rng.randint(1, 60)])
            if any(ch in x for ch in ',"\n'):
                x = '"' + x.replace('""', '"').replace('"', '""') + '"'
            elif rng.random() < 0.3:
                x = f'"{x}"'
            cells.append(x)
        out.append(",".join(cells))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("split", ["67108864", "4096", "97"])
def test_records_over_lines_and_splits(spark, tmpdir_path, split):
    """Quoted breaks across many splits: every record whole, numbered by its first line."""
    text = made(5, 400)
    path = put(tmpdir_path, "a.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows_of(src.read_csv(spark, path, SourceConfig(properties={"nullValues": "\x01"})))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(at, *cells) for at, cells in expected(text)[1:]]
    assert [(r, *[c or None for c in cells]) for r, *cells in got] == want


def test_no_cell_of_a_headerless_file_is_cut(spark, tmpdir_path):
    """Four quoted breaks in each row: nine cells, all of them."""
    row = ",".join(f'"c{i}\nx"' if i % 2 else f"c{i}" for i in range(9))
    path = put(tmpdir_path, "h.csv", "\n".join([row] * 3) + "\n")
    df = src.read_csv(spark, path, SourceConfig(has_header=False))
    rows = rows_of(df)
    assert [r[0] for r in rows] == [1, 6, 11] and len(rows[0]) == 10
    assert rows[0][1:] == tuple(f"c{i}\nx" if i % 2 else f"c{i}" for i in range(9))


def test_bare_quotes_are_text_and_keep_the_line_path(spark, tmpdir_path):
    path = put(tmpdir_path, "p.csv", 'id,name\n1,5" pipe\n2,"a 6"" pipe"\n3,x\n')
    df = src.read_csv(spark, path, SourceConfig())
    assert rows_of(df) == [(2, "1", '5" pipe'), (3, "2", 'a 6" pipe'), (4, "3", "x")]
    assert "multiLine" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_without_breaks_shuffle_no_lines(spark, tmpdir_path):
    path = put(tmpdir_path, "q.csv", "id,name\n" + "".join(f'{i},"n{i}"\n' for i in range(50)))
    plan = src.read_csv(spark, path, SourceConfig())._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_unclosed_quote_is_an_error(spark, tmpdir_path):
    path = put(tmpdir_path, "u.csv", 'id,name\n1,a\n2,"open\n3,b\n')
    with pytest.raises(src.UnclosedQuote, match="line 3"):
        src.read_csv(spark, path, SourceConfig())


def test_files_are_numbered_each_for_itself(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "many")
    os.makedirs(folder)
    put(folder, "1.csv", 'id,v\n1,"a\nb"\n2,c\n')
    put(folder, "2.csv", 'id,v\n3,d\n4,"e\n\nf"\n5,g\n')
    got = rows_of(src.read_csv(spark, folder, SourceConfig()))
    assert got == [(2, "1", "a\nb"), (4, "2", "c"), (2, "3", "d"), (3, "4", "e\n\nf"), (6, "5", "g")]


@pytest.mark.parametrize("encoding", ["windows-1252", "ISO-8859-15", "ISO-8859-1", "UTF-16"])
def test_other_encodings(spark, tmpdir_path, encoding):
    text = 'id,name\n1,"café\nnaïve"\n2,señor\n'
    if encoding in ("windows-1252", "ISO-8859-15"):
        text += "3,5 €\n"
    path = put(tmpdir_path, "e.csv", text, encoding)
    got = [r[1:] for r in rows_of(src.read_csv(spark, path, SourceConfig(encoding=encoding)))]
    assert got[:2] == [("1", "café\nnaïve"), ("2", "señor")] and (len(got) == 2 or got[2] == ("3", "5 €"))


def test_escape_character_other_than_the_quote(spark, tmpdir_path):
    path = put(tmpdir_path, "b.csv", 'id;v\n1;"a \\" b\nc"\n2;"d\\\\"\n3;e\n')
    got = rows_of(src.read_csv(spark, path, SourceConfig(delimiter=";", properties={"escapeChar": "\\"})))
    assert got == [(2, "1", 'a " b\nc'), (4, "2", "d\\"), (5, "3", "e")]
