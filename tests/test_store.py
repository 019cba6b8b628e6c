import glob
import os

import pytest
from pyspark.sql import functions as F

from leafmill.sources import store


def test_snapshots_retention_and_recovery(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    for i in range(4):
        store.save(spark.range(i + 1).coalesce(1), path, keep=3)
    assert len(store.snapshots(spark, path)) == 3 and store.load(spark, path).count() == 4
    newest = store.snapshots(spark, path)[-1]
    for f in glob.glob(f"{newest}/part-*"):
        open(f, "wb").write(b"damaged")
    for f in glob.glob(f"{newest}/.part-*.crc"):
        open(f, "wb").write(b"")
    assert store.load(spark, path).count() == 3


def test_damage_in_any_file(spark, tmp_path):
    path = str(tmp_path / "t")
    store.save(spark.range(10), path)
    store.save(spark.range(1000).repartition(4), path)
    newest = store.snapshots(spark, path)[-1]
    last = sorted(glob.glob(f"{newest}/part-*"))[-1]
    raw = open(last, "rb").read()
    for crc in glob.glob(f"{newest}/.part-*.crc"):
        os.remove(crc)
    open(last, "wb").write(raw[:-9])
    assert store.load(spark, path).count() == 10
    open(last, "wb").write(raw)
    assert store.load(spark, path).count() == 1000
    open(last, "wb").write(raw[:4] + b"\xff" * (len(raw) - 12) + raw[-8:])  # the size is kept
    assert store.load(spark, path, read_all=True).count() == 10


def test_snapshots_lie_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        store.save(spark.range(i + 1), path, least_seconds=3600)
    assert len(store.snapshots(spark, path)) == 2 and store.load(spark, path).count() == 5


def test_manifest_and_round_trip(spark, tmp_path):
    df = spark.range(50).withColumn("t", F.concat(F.lit("é\n"), F.col("id").cast("string")))
    store.export_json(df, str(tmp_path / "j"))
    back, damaged = store.import_json(spark, str(tmp_path / "j"), df.schema)
    assert damaged.isEmpty()
    a, b = store.manifest({"x": df}).first(), store.manifest({"x": back.repartition(7)}).first()
    assert a == b and a.n == 50


def test_damaged_lines_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t"\n\n{"id": "three", "t": "y"}\nnull\n{"t": "z"}\n  \n')
    rows, damaged = store.import_json(spark, str(tmp_path), spark.createDataFrame([], "id long, t string").schema)
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "x"), (None, "z")]
    assert sorted(r.line for r in damaged.collect()) == ["null", '{"id": "three", "t": "y"}', '{"id": 2, "t"'] and damaged.first().file.endswith("a.json")


def test_upgrades(spark):
    steps = [(3, {"tags": F.split("label", ",")}), (1, {"label": F.lower("title")}), (2, {"label": F.concat("label", F.lit(",old"))})]
    rows = spark.createDataFrame([(None, "A", None), (1, "B", "b"), (2, "C", "own"), (3, "D", "kept")], "version int, title string, label string")
    once = store.upgraded(rows, steps)
    want = [(3, "A", "a,old", ["a", "old"]), (3, "B", "b,old", ["b", "old"]), (3, "C", "own", ["own"]), (3, "D", "kept", None)]
    assert sorted(map(tuple, once.collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, store.upgraded(once, steps).collect()), key=lambda r: r[1]) == want
