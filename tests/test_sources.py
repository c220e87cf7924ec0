"""CSV source and sink (IO1, IO2)."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from returnlens.sources import files as FS


def test_csv_na_tokens_and_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rl-csv-")
    src = os.path.join(d, "in.csv")
    with open(src, "w") as f:
        f.write("Price,Category,Returned\n")
        f.write("12.5,Books,1\n")
        f.write("NA,N/A,0\n")
        f.write(",null,1\n")
        f.write("nan,  NA,0\n")  # padded text is not a token
    df = FS.read_csv(spark, src, "Price double, Category string, Returned int")
    got = [tuple(r) for r in df.collect()]
    assert got == [(12.5, "Books", 1), (None, None, 0), (None, None, 1), (None, "  NA", 0)]
    out = os.path.join(d, "out")
    FS.write_csv(df, out)
    back = FS.read_csv(spark, out, "Price double, Category string, Returned int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(got, key=str)


def test_csv_without_schema_reads_text(spark):
    d = tempfile.mkdtemp(prefix="rl-csv-")
    src = os.path.join(d, "in.csv")
    with open(src, "w") as f:
        f.write("a,b\n1,x\n,y\n")
    df = FS.read_csv(spark, src)
    assert dict(df.dtypes) == {"a": "string", "b": "string"}
    assert [r["a"] for r in df.collect()] == ["1", None]


CSV_SCHEMA = "id long, note string, x double"


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    import csv

    rows_in = [(1, 'say "hi", ok', 1.5), (2, "two\nlines", None), (3, " spaces ", -2.0), (4, "back\\slash \\", 0.0), (5, None, 1.0)]
    df = spark.createDataFrame(rows_in, CSV_SCHEMA)
    FS.write_csv(df.coalesce(1), str(tmp_path / "own"))
    back = FS.read_csv(spark, str(tmp_path / "own"), CSV_SCHEMA, multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows_in
    part = next((tmp_path / "own").glob("*.csv"))
    with open(part, newline="") as f:            # what another reader sees
        seen = list(csv.reader(f))
    assert seen[0] == ["id", "note", "x"] and [r[1] for r in seen[1:]] == [r[1] or "" for r in rows_in]
    with open(tmp_path / "theirs.csv", "w", newline="") as f:
        csv.writer(f).writerows([["id", "note", "x"], *[[a, b, c] for a, b, c in rows_in]])
    back = FS.read_csv(spark, str(tmp_path / "theirs.csv"), CSV_SCHEMA, multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows_in


def test_csv_unreadable_cells_raise_or_are_counted(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,note,x\n1,a,NA\nzwei,b,2.0\n3,c,x\n")
    path = str(tmp_path / "bad.csv")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        FS.read_csv(spark, path, CSV_SCHEMA).collect()
    got = FS.read_csv(spark, path, CSV_SCHEMA, bad_cells="count").collect()
    assert sorted((r["note"], r["id"], r["x"], r["bad_cells"]) for r in got) == [("a", 1, None, 0), ("b", None, 2.0, 1), ("c", 3, None, 1)]


def test_csv_records_of_wrong_length_raise(spark, tmp_path):
    (tmp_path / "short.csv").write_text("id,note,x\n1,a,1.0\n2,b\n")
    with pytest.raises(Exception, match="MALFORMED"):
        FS.read_csv(spark, str(tmp_path / "short.csv"), CSV_SCHEMA).collect()


def test_inferred_types_are_the_least_that_fit(spark):
    cells = {"b": ["true", "FALSE", None], "i": ["1", " -2 ", None], "d": ["1", "2.5", "inf"], "s": ["1", "x", None], "mix": ["true", "1", None],
             "none": [None, None, None], "long": ["9223372036854775807", "9223372036854775808", "0"], "d2": ["1d", "2", "3"]}
    text = spark.createDataFrame(list(zip(*cells.values())), ", ".join(f"{c} string" for c in cells))
    types = FS.infer_types(text)
    assert types == {"b": "boolean", "i": "bigint", "d": "double", "s": "string", "mix": "string", "none": "double", "long": "double", "d2": "string"}
    out = FS.with_types(text, types)
    assert [t for _, t in out.dtypes] == list(types.values())
    assert [tuple(r)[:3] for r in out.collect()] == [(True, 1, 1.0), (False, -2, 2.5), (None, None, float("inf"))]
    assert FS.infer_types(text.limit(0)) == dict.fromkeys(cells, "double")


def test_a_cell_after_the_first_rows_still_rules_a_type_out(spark, monkeypatch):
    """Types that the first rows rule out are not tried on the others; all cells are tried for the rest."""
    tried = []
    counted = FS._fit_counts
    monkeypatch.setattr(FS, "FIRST_ROWS", 2)
    monkeypatch.setattr(FS, "_fit_counts", lambda text, kinds: (tried.append({c: list(k) for c, k in kinds.items()}), counted(text, kinds))[1])
    rows_in = [("x", "1", None, "1", "true"), ("y", "2", None, "2", "false"), ("1", "3", "7", "2.5", "1"), ("2", "4", None, "x", "true")]
    text = spark.createDataFrame(rows_in, "s string, i string, late string, turns string, b string").coalesce(1)
    assert FS.infer_types(text) == {"s": "string", "i": "bigint", "late": "bigint", "turns": "string", "b": "string"}
    assert tried[1] == {"s": [], "i": ["bigint", "double"], "late": ["boolean", "bigint", "double"], "turns": ["bigint", "double"], "b": ["boolean"]}


def test_white_space_around_numbers(spark):
    from returnlens.functions.coerce import text_to_double
    cells = [" 1", "2\t", "\n3\r\n", "\x0b\f4", " -inf ", "5 6", "", "  ", " 7", None]
    got = spark.createDataFrame([(c,) for c in cells], "t string").select(text_to_double(F.col("t"))).collect()
    assert [r[0] for r in got] == [1.0, 2.0, 3.0, 4.0, float("-inf"), None, None, None, None, None]
