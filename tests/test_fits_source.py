"""FITS tables as a data source: splits, scaled columns, heaps, cards, writers."""

import numpy as np
import pytest

from pixelframe.sources import fits_source as fits
from pixelframe.sources import io


def table(cards, body, heap=b"", first=()):
    raw = body + heap
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), *cards[:2], ("PCOUNT", len(heap)), ("GCOUNT", 1), *cards[2:]]
    return io._cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), *first]) + io._cards(head) + raw.ljust(-(-len(raw) // io.BLOCK) * io.BLOCK, b"\0")


def test_splits(spark, tmp_path):
    """One file is read by many tasks, each row once, whatever the bounds of the splits."""
    fits.register(spark)
    n = 5000
    cols = {"id": np.arange(n), "v": np.arange(2 * n, dtype=np.float32).reshape(n, 2), "name": np.array([f"s{k % 13}" for k in range(n)], object)}
    (tmp_path / "a.fits").write_bytes(io.to_fits(cols))
    for split in (997, 4096, 1 << 25):
        df = spark.read.format("fits").option("split", split).load(str(tmp_path / "a.fits"))
        assert df.dtypes == [("id", "bigint"), ("v", "array<float>"), ("name", "string")]
        assert (df.rdd.getNumPartitions() > 20) == (split < 5000)
        rows = df.collect()
        assert sorted(r.id for r in rows) == list(range(n)) and all(list(r.v) == [2 * r.id, 2 * r.id + 1] and r.name == f"s{r.id % 13}" for r in rows)
    few = spark.read.format("fits").schema("name string, id int").load(str(tmp_path))
    assert few.dtypes == [("name", "string"), ("id", "int")] and few.agg({"id": "sum"}).first()[0] == n * (n - 1) // 2


def test_forms(spark, tmp_path):
    """Scale, unsigned numbers, nulls, bits, complex numbers, arrays of varying length, and cards of both headers."""
    fits.register(spark)
    row = np.dtype([("u", ">i2"), ("s", ">i4"), ("k", ">i4"), ("x", "u1", 2), ("c", ">f4", 2), ("p", ">i4", 2), ("l", "S1")])
    t = np.zeros(3, row)
    t["u"], t["s"], t["k"], t["x"], t["c"] = [-32768, 0, 32767], [1, 2, 3], [7, -99, 9], [[0b10100000, 0b01000000]] * 3, [[1, 2], [3, 4], [5, 6]]
    t["p"], t["l"] = [[2, 4], [0, 0], [1, 0]], [b"T", b"F", b"\0"]
    heap = np.array([5, 6, 7], ">i4").tobytes()
    cards = [("NAXIS1", row.itemsize), ("NAXIS2", 3), ("TFIELDS", 7)]
    for k, (name, form) in enumerate((("u", "I"), ("s", "J"), ("k", "J"), ("x", "10X"), ("c", "C"), ("p", "1PJ(2)"), ("l", "L")), 1):
        cards += [(f"TTYPE{k}", name), (f"TFORM{k}", form)]
    cards += [("TZERO1", 32768), ("TSCAL2", 0.5), ("TZERO2", 10.0), ("TNULL3", -99), ("EXPTIME", 90.5)]
    (tmp_path / "f.fits").write_bytes(table(cards, t.tobytes(), heap, [("FILTER", "r")]))
    got = spark.read.format("fits").load(str(tmp_path / "f.fits"))
    assert [k for _, k in got.dtypes] == ["int", "double", "int", "array<boolean>", "array<float>", "array<int>", "boolean"]
    rows = got.collect()
    assert [r.u for r in rows] == [0, 32768, 65535] and [r.s for r in rows] == [10.5, 11.0, 11.5] and [r.k for r in rows] == [7, None, 9]
    assert rows[0].x == [True, False, True] + [False] * 6 + [True] and [list(r.c) for r in rows] == [[1, 2], [3, 4], [5, 6]]
    assert [list(r.p) for r in rows] == [[6, 7], [], [5]] and [r.l for r in rows] == [True, False, None]
    named = spark.read.format("fits").schema("s double, exptime double, filter string").load(str(tmp_path / "f.fits")).collect()
    assert [tuple(r) for r in named] == [(10.5, 90.5, "r"), (11.0, 90.5, "r"), (11.5, 90.5, "r")]
    with pytest.raises(Exception, match="neither a column nor a header card"):
        spark.read.format("fits").schema("nothing int").load(str(tmp_path / "f.fits")).collect()


def test_writer(spark, tmp_path):
    """Files appear together, appended ones stay, overwritten ones go; of a failed write nothing is read; empty tables have no rows."""
    fits.register(spark)
    out = str(tmp_path / "out")
    df = spark.range(100).selectExpr("id", "id / 4 AS v", "concat('n', id) AS name", "array(id, id + 1) AS pair")
    df.repartition(3).write.format("fits").mode("append").save(out)
    df.write.format("fits").mode("append").save("file://" + out)
    assert spark.read.format("fits").load(out).groupBy().sum("id").first()[0] == 2 * 4950
    df.where("id < 10").write.format("fits").mode("overwrite").save(out)
    got = spark.read.format("fits").load(out)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.id, r.v, r.name, r.pair) for r in df.where("id < 10").collect())
    bad = df.selectExpr("id", "CASE WHEN id = 99 THEN raise_error('no') ELSE id END AS v")
    with pytest.raises(Exception, match="no"):
        bad.write.format("fits").mode("append").save(out)
    assert got.count() == 10 and len(list((tmp_path / "out").glob("*.fits"))) == len(fits.files(out))
    many = str(tmp_path / "many")
    odd = df.selectExpr("id", "CASE WHEN id > 3 THEN v END AS v", "CASE WHEN id > 3 THEN name END AS name")
    odd.coalesce(1).write.format("fits").option("rows", 30).mode("append").save(many)
    assert len(fits.files(many)) == 4
    rows = {r.id: r for r in spark.read.format("fits").load(many).collect()}
    assert len(rows) == 100 and rows[5].v == 1.25 and rows[5].name == "n5" and np.isnan(rows[3].v) and rows[3].name == ""
    with pytest.raises(Exception, match="nulls can only be written"):
        df.selectExpr("nullif(id, 3) AS id").write.format("fits").mode("append").save(many)
    (tmp_path / "none.fits").write_bytes(io.to_fits({"id": np.zeros(0, np.int64)}))
    assert spark.read.format("fits").load(str(tmp_path / "none.fits")).count() == 0
    df.limit(0).write.format("fits").mode("append").save(str(tmp_path / "void"))
    assert spark.read.format("fits").schema("id long").load(str(tmp_path / "void")).count() == 0
