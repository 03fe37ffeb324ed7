"""CSV records with their lines, whatever the splits."""

import csv
import io
import random

import pytest

from frondlake.sources.records import inside_after, read_records


def table(seed, rows):
    """CSV text and (line, fields) of each record by the standard library."""
    rng = random.Random(seed)
    pieces = ["a", "b c", ",", "\n", '"', "\n\n", '",', "é", "", 'x"y']
    data = [["".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(3)] for _ in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows([["h1", "h2", "h3"], *data])
    text, found, before = out.getvalue(), [], 0
    reader = csv.reader(io.StringIO(text, newline=""))
    for fields in reader:
        found.append((before + 1, fields))
        before = reader.line_num
    return text, found


def test_quote_state():
    assert inside_after('a,"b', False) and not inside_after('a,"b"', False) and not inside_after('a 5" b,c', False)
    assert inside_after('b""c', True) and not inside_after('b""",c', True) and inside_after('b","c', True)
    assert inside_after('b"x,"', True) and not inside_after('b"x"y"', True) and inside_after("", True)


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_lines_equal_a_sequential_reader(spark, tmp_path, size):
    want = {}
    for seed in range(4):
        text, found = table(seed, 200)
        (tmp_path / f"{seed}.csv").write_text(text, newline="")
        want |= {(f"{seed}.csv", line): fields for line, fields in found}
    (tmp_path / "empty.csv").write_text("")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): next(csv.reader(io.StringIO(r["record"], newline="")))
               for r in read_records(spark, str(tmp_path)).collect()}
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert got == {k: v for k, v in want.items() if v}


def test_carriage_returns_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h,i\r\n\r\n1,"x\r\ny"\r\n\n2,z')
    got = sorted((r["line"], r["record"]) for r in read_records(spark, str(tmp_path)).collect())
    assert got == [(1, "h,i"), (3, '1,"x\r\ny"'), (6, "2,z")]


def test_an_unclosed_quote_is_one_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"a\nb\nc\n')
    assert sorted((r["line"], r["record"]) for r in read_records(spark, str(tmp_path)).collect()) == [(1, "h"), (2, '"a\nb\nc')]
