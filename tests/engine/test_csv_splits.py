"""CSV in splits against the reader that gives a file to one task."""

import random

import pytest

from tremolo.sources import csv_splits, tables


def write(path, rows, end, seed, tail=""):
    rng = random.Random(seed)

    def cell():
        roll = rng.random()
        if roll < 0.2:
            return rng.choice(["", '""'])
        if roll < 0.6:
            return str(rng.randint(0, 999))
        return '"' + "".join(rng.choice(["a", "b", " ", ",", end, '""', "é", end + end, '"",""']) for _ in range(rng.randint(0, 40))) + '"'

    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(f'x,"y{end}z",w{end}')
        for i in range(rows):
            f.write(f"{i},{cell()},{cell()}{end}{end if rng.random() < 0.1 else ''}")
        f.write(tail)


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def of(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 0)
        spark.conf.set(keys[2], 1)

    yield of
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_serial_read(spark, tmp_path, split_size, end):
    path = str(tmp_path / "a.csv")
    write(path, 1500, end, 1)
    serial = tables.read_csv(spark, path, whole_files=True)
    want = [(i, *r) for i, r in enumerate(serial.collect())]
    for size in (1 << 30, 20_000, 1500):
        split_size(size)
        got = csv_splits.read(spark, path, serial.schema)
        assert got.columns == ["row_id", *serial.columns]
        # that reader turns line breaks of two characters inside quotes into one; here texts are kept as they are
        plain = lambda x: x.replace("\r\n", "\n") if isinstance(x, str) else x
        assert sorted(tuple(map(plain, r)) for r in got.collect()) == want
    assert csv_splits._lines(spark, path).rdd.getNumPartitions() > 20


def test_a_record_over_many_splits(spark, tmp_path, split_size):
    path = str(tmp_path / "b.csv")
    long = "\n".join(f"line {i} of it" for i in range(2000))
    with open(path, "w", newline="") as f:
        f.write(f'k,v\n1,"{long}"\n2,"""q"""\n3,\n4,"{long}\nopen to the end')
    split_size(1000)
    got = sorted(map(tuple, tables.read_csv(spark, path, row_id="n").collect()))
    assert got[:3] == [(0, "1", long), (1, "2", '"q"'), (2, "3", None)]
    assert got[3][:2] == (3, "4") and got[3][2].endswith("open to the end") and len(got) == 4


def test_several_files_empty_lines_and_bad_bytes(spark, tmp_path, split_size):
    (tmp_path / "d").mkdir()
    for name, body in (("1", b'a,b\n1,x\xff\n\n2,"y\n\nz"\n'), ("2", b"a,b\n"), ("3", b'a,b\n3,"p\r\nq"\n4,w')):
        (tmp_path / "d" / f"{name}.csv").write_bytes(body)
    want = [(0, "1", "x�"), (1, "2", "y\n\nz"), (2, "3", "p\r\nq"), (3, "4", "w")]
    for size in (1 << 20, 5):
        split_size(size)
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "d"), row_id="n").collect())) == want
    typed = tables.read_csv(spark, str(tmp_path / "d"), "a int, b string")
    assert sorted(r.a for r in typed.collect()) == [1, 2, 3, 4]


def test_too_many_splits(spark, tmp_path, split_size, monkeypatch):
    write(str(tmp_path / "c.csv"), 200, "\n", 2)
    split_size(500)
    monkeypatch.setattr(csv_splits, "MAX_SPLITS", 3)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        csv_splits.scan(spark, str(tmp_path / "c.csv"))
