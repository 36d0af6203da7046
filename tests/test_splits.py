"""Quoted line ends across byte ranges give the rows of a reader that sees the whole file."""

import csv
import io
import random

import pytest

from proofsheet.sources import splits
from proofsheet.sources.delimited import read_delimited


def expected(text, delimiter=","):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    return rows[1:], len(rows[0])


def read(spark, path, header, split, delimiter=",", encoding="utf-8"):
    df = splits.read_records(spark, [str(path)], header, delimiter, encoding, "__overflow", split)
    return df, [[c for c in tuple(r)[:len(header)]] for r in df.collect()]


def odd_field(rnd):
    kind = rnd.randrange(7)
    word = "".join(rnd.choices("abä€ ", k=rnd.randrange(0, 6)))
    return ['"' + word.replace("a", '""') + '"', '"' + word + "\n" + word + '"', word, word + '"' + word, '"\n\n"', '"a,b"', '"x\r\n"'][kind]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_the_rows_of_one_read(spark, tmp_path, seed):
    rnd = random.Random(seed)
    lines = ["k,v,w"] + [",".join(odd_field(rnd) for _ in range(3)) for _ in range(300)] + ['last,"' + "long\n" * 400 + '",z']
    text = "\n".join(lines) + rnd.choice(["", "\n"])
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    want, width = expected(text)
    want = [(r + [None] * width)[:width] for r in want]
    for split in (64, 333, 10**9):
        df, got = read(spark, path, ["k", "v", "w"], split)
        assert [[c or "" for c in r] for r in got] == [[c or "" for c in r] for r in want], split
    assert splits.ranges(spark, [str(path)], 64).count() == -(-len(text.encode()) // 64)


def test_scan_states_do_not_depend_on_chunks():
    rnd = random.Random(9)
    for _ in range(400):
        data = "".join(rnd.choices(['"', '""', ",", "\n", "a", '\n"', ',"'], k=rnd.randrange(0, 30))).encode()
        for quoted in (False, True):
            whole = splits.Scan(",", quoted)
            whole.last = b"x" if quoted else b"\n"
            whole.step(data + b"\n")
            pieces = splits.Scan(",", quoted)
            pieces.last = whole.last if False else (b"x" if quoted else b"\n")
            rest = data + b"\n"
            while rest:
                n = rnd.randrange(1, 4)
                pieces.step(rest[:n])
                rest = rest[n:]
            assert whole.inside() == pieces.inside(), data


def test_read_delimited_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "SPLIT_BYTES", 40)
    monkeypatch.setattr(splits.read_records, "__defaults__", (40,))
    (tmp_path / "a.csv").write_bytes("\ufeffk,v\n1,\"a\nb\"\n\n2,\"say \"\"hi\"\"\"\n3,\n".encode())
    (tmp_path / "b.csv").write_bytes("k,v\r\n4,\"x\r\ny\"\r\n5,plain".encode())
    (tmp_path / "c.csv").write_bytes("المدينة\tv\nالرياض\t\"1\n2\"\n".encode("cp1256"))
    df = read_delimited(spark, str(tmp_path))
    got = sorted((r["k"], r["v"]) for r in df.where("k is not null").collect())
    assert got == [("1", "a\nb"), ("2", 'say "hi"'), ("3", None), ("4", "x\r\ny"), ("5", "plain")]
    assert [tuple(r) for r in df.where("k is null").select("المدينة", "v").collect()] == [("الرياض", "1\n2")]
    assert df.select("__source_file").distinct().count() == 3
