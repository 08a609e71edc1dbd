"""CSV files: ranges, quotes, odd rows, and what is refused."""

import csv
import io
import random

import pytest

from tallyweave.sources import records
from tallyweave.sources.frames import BadInput, _records, from_csv, raw_csv


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,a,a,when,amount\n1,2.5,x,2024-01-02,\"1,000\"\n2,NA,y,2024-01-03,\"2,500\"\n3,4.5,x,2024-02-01,30\n")
    f = from_csv(spark, f"file://{p}")
    assert f.columns == ["id", "a", "a.1", "when", "amount"]
    assert f.df.schema["id"].dataType.simpleString() == "bigint" and f.df.schema["a"].dataType.simpleString() == "double"
    p2 = tmp_path / "empty.csv"
    p2.write_text("a,b\n")
    with pytest.raises(BadInput):
        from_csv(spark, f"file://{p2}")


def test_csv_with_quotes_line_breaks_and_short_rows(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,said,n\n1,"say ""hi"" now",1\n2,"two\nlines, one field",2\n3,short\n\n4,"",4\n')
    f = from_csv(spark, f"file://{p}")
    rows = [tuple(r) for r in f.df.select("id", "said", "n").orderBy("id").collect()]
    assert rows == [(1, 'say "hi" now', 1), (2, "two\nlines, one field", 2), (3, "short", None), (4, None, 4)]


@pytest.mark.parametrize("data", [b"", b"  \n \n", bytes(range(256)) * 4, b"a,b\n1,2\n1,2,3\n", None])
def test_bad_csv(spark, tmp_path, data):
    p = tmp_path / "bad.csv"
    if data is not None:
        p.write_bytes(data)
    with pytest.raises(BadInput):
        from_csv(spark, f"file://{p}")


def test_csv_over_the_limit(spark, tmp_path):
    p = tmp_path / "large.csv"
    p.write_text("a,b\n" + "1,2\n" * 100)
    assert from_csv(spark, f"file://{p}", most_bytes=404).df.count() == 100
    with pytest.raises(BadInput, match="limit"):
        from_csv(spark, f"file://{p}", most_bytes=403)


def odd_file(seed, rows=400):
    """Fields with quotes, separators and line breaks, quotes within plain fields, short rows and blank lines."""
    r = random.Random(seed)
    out = ["a,b,c"]
    for i in range(rows):
        fields = [r.choice([str(i), '"x, y"', '"two\nlines"', '"say ""hi"" now"', '5" pipe', 'a"b"c', '""', "", '"\n\n\n"', '"long ' + "z\n" * r.randint(0, 60) + '"', '"q"tail', "é ü 漢字"]) for _ in range(3)]
        out += [""] * (r.random() < 0.05) + ["  \t"] * (r.random() < 0.03) + [",".join(fields[: r.choice([3, 3, 3, 2])])]
    return out


def whole(text):
    """The rows of a file that is read at once."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip(" \t") for c in r) or len(r) > 1]
    return [tuple(r + [None] * (3 - len(r))) for r in rows[1:]]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("range_bytes", [97, 1000, 10**6])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, end, range_bytes):
    p = tmp_path / "odd.csv"
    lines = [x for x in odd_file(3) if x != '""']
    p.write_bytes(end.join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        n = records.lines_of(spark, f"file://{p}").rdd.getNumPartitions()
        table, _ = _records(spark, f"file://{p}", None, ",")
        got = [tuple(r)[1:] for r in table.orderBy("row").collect()]
        places = sorted(r["row"] for r in table.select("row").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert n > 20 or range_bytes > 97
    assert got == whole(end.join(lines)) and places == list(range(len(got)))


def test_a_null_last_field_is_no_short_row(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,,3\n")
    with pytest.raises(BadInput, match="3 fields"):
        from_csv(spark, f"file://{p}")
    p = tmp_path / "y.csv"
    p.write_text("a,b\n1,\n2,x\n")
    assert [tuple(r) for r in from_csv(spark, f"file://{p}").df.select("a", "b").orderBy("a").collect()] == [(1, None), (2, "x")]


def test_codes_are_no_numbers(spark, tmp_path):
    p = tmp_path / "codes.csv"
    p.write_text("code,hex,real,edge\n2d,0x1p3,.5,inf\n3f,7,5.,-Infinity\n4D,8,1e5,+2\n")
    f = from_csv(spark, f"file://{p}")
    assert [f.df.schema[c].dataType.simpleString() for c in f.columns] == ["string", "string", "double", "double"]
    assert [tuple(r) for r in f.df.orderBy("__row").select("real", "edge").collect()] == [(0.5, float("inf")), (5.0, float("-inf")), (1e5, 2.0)]


@pytest.mark.parametrize("data", [b"a,b\n1,\xff\n", b"a,b\n1,2\n3,\xc3\n", b'a,b\n1,"\xe9"\n', b"\xff,b\n1,2\n"])
def test_bytes_that_are_no_utf8(spark, tmp_path, data):
    p = tmp_path / "bytes.csv"
    p.write_bytes(data)
    with pytest.raises(BadInput, match="UTF-8"):
        from_csv(spark, f"file://{p}")


@pytest.mark.parametrize("data,why", [(b'a,b\n1,"2\n3,4\n', "quotes"), (b"a,b\r1,2\r", "header|line end"), (b"a,b\n1,2\r3,4\n", "line end")])
def test_records_that_do_not_end(spark, tmp_path, data, why):
    p = tmp_path / "open.csv"
    p.write_bytes(data)
    with pytest.raises(BadInput, match=why):
        from_csv(spark, f"file://{p}")


@pytest.mark.parametrize("head,names", [("a,A", ["a", "A.1"]), ("a,a,a.1", ["a", "a.1", "a.1.1"]), ("x,,X", ["x", "column 2", "X.1"]), ("\ufeffid,b", ["id", "b"]), ('"q,1","q\n2"', ["q,1", "q\n2"])])
def test_headers(spark, tmp_path, head, names):
    p = tmp_path / "head.csv"
    p.write_text(head + "\n" + ",".join("123"[: len(names)]) + "\n")
    f = from_csv(spark, f"file://{p}")
    assert f.columns == names and raw_csv(spark, f"file://{p}").columns == names
    assert list(f.df.first())[: len(names)] == [1, 2, 3][: len(names)]


def test_a_folder_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("n,t\n" + "".join(f'{10 * k + i},"a\nb"\n' for i in range(4)))
    f = from_csv(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in f.df.orderBy("__row").select("__row", "n").collect()] == [(4 * k + i, 10 * k + i) for k in range(3) for i in range(4)]
    (tmp_path / "part9.csv").write_text("n,other\n1,2\n")
    with pytest.raises(BadInput, match="different headers"):
        from_csv(spark, f"file://{tmp_path}")
