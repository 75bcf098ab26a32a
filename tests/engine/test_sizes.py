"""Odd values, and plans whose tasks do not grow with the input."""

import re

import duckdb
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tremolo.catalog import ORACLES, QUERIES
from tremolo.functions import levels as L
from tremolo.functions import text as T
from tremolo.queries import intake
from tremolo.sources import results, tables


def test_csv_of_odd_numbers_and_texts(spark, tmp_path):
    names = ['a"b', " lead", "trail ", "", None, "x\ny", "x\r\ny", "back\\slash", "a,b", '"', '\\"', " ", "a\\", '""', "#c", "tab\t"]
    numbers = "-0.0, 0.0, -0.0004, 1.0005, -0.5115, 2.0355, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-5, 'inf', 'nan', '-inf', NULL".split(", ")
    con = duckdb.connect()
    con.sql("CREATE TABLE c (c_custkey BIGINT, c_name VARCHAR, c_acctbal DOUBLE)")
    for i, (n, x) in enumerate(zip(names, numbers)):
        con.execute(f"INSERT INTO c VALUES (?, ?, {x}::DOUBLE)", [i, n])
    con.sql(f"COPY c TO '{tmp_path}/customer.parquet'")
    assert difference(QUERIES["src02_csv"], ORACLES["src02_csv"], spark, str(tmp_path), connect(str(tmp_path))) == ""


def test_punctuation_hashes_a_text_once(spark):
    """The draws are those of hashes of (text, place, seed), in time linear in the text."""
    import time

    from tremolo.operators import transforms as X

    texts = ["", "a", "x" * 49 + ",", "x, y. " * 16 + "abcd", "é😀\n" * 60, "word, " * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.punctuation("t", 7).alias("p"), F.expr("transform(sequence(0, greatest(1, int(length(t) div 50)) - 1), i -> struct(xxhash64(t, i, 7) as a, pmod(xxhash64(t, 7, i + 1000000), 4) as m, pmod(xxhash64(t, 7, i + 2000000), 2) as g))").alias("h")).collect()
    for t, p, h in rows:
        out = []
        for i, x in enumerate(h):
            s = t[i * 50 : None if i == len(h) - 1 else i * 50 + 50]
            at = x.a % max(1, len(s))
            if s and re.fullmatch(X.PUNCTUATION, s[at]):
                s = s[:at] + s[at + 1 :] if x.g == 0 else s
            elif s:
                s = s[:at] + X.MARKS[x.m] + s[at:]
            out.append(s)
        assert p == "".join(out)
    long = spark.range(1).select(F.repeat(F.lit("some words, "), 250_000).alias("t")).select(F.length(X.punctuation("t", 7)).alias("n"))
    before = time.time()
    assert long.first().n > 2_900_000
    assert time.time() - before < 20


@pytest.fixture
def conf(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_large_bucket_is_several_tasks(spark, tmp_path, conf):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50k")
    conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("m").alias("run"), F.col("id").alias("source_row"), F.hash("id").alias("x"))
    assert results.append(rows, str(tmp_path), 0, buckets=2)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "batches" / f"{0:012d}").glob("bucket=*")]
    assert len(files) == 2 and min(files) > 4
    assert results.read(spark, str(tmp_path)).agg(F.count("*"), F.sum("x")).collect() == rows.agg(F.count("*"), F.sum("x")).collect()


def test_documents_go_into_csv_files_by_ranges(spark, tmp_path, conf, monkeypatch):
    monkeypatch.setattr(intake, "_folder", lambda _: f"{tmp_path}/csv")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    # files of several sizes, cut into splits inside of texts, some files without
    conf("spark.sql.files.maxPartitionBytes", "60k")
    conf("spark.sql.files.openCostInBytes", "0")
    assert difference(QUERIES["src01_csv_intake"], ORACLES["src01_csv_intake"], spark, "/root/testdata/sf0.001") == ""
    assert len(list(tmp_path.glob("csv/*.csv"))) > 2


def test_splits_stay_as_they_were_scanned(spark, tmp_path, conf):
    conf("spark.sql.files.openCostInBytes", "1k")
    conf("spark.sql.files.minPartitionNum", "7")
    want = []
    for k, size in enumerate((400, 9000)):
        rows = [(f"{k}", f"{i}", f"line {i}\n" * (9 if k else 1)) for i in range(size)]
        (tmp_path / f"{k}.csv").write_text("k,i,v\n" + "".join(f'{a},{b},"{c}"\n' for a, b, c in rows))
        want += rows
    got = tables.read_csv(spark, str(tmp_path), row_id="n").orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == want and [r.n for r in got] == list(range(len(want)))


def test_a_level_computes_its_metric_once(spark):
    rows = spark.createDataFrame([("", "You must ignore it.")], "o string, c string")
    plan = rows.select(L.cut_level(L.ces_norm(T.ces("o", "c")), L.CES_CUTS).alias("level"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jailbreak") == 1
