"""Listings, archives by members, arrays, and files that are there whole or not at all."""

import io
import os
import sys
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wavemill.functions import digits
from wavemill.sources import files, listing, media


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files.register(spark)


def test_listing_and_existing_files(spark, tmp_path):
    root = tmp_path / "it's here"
    for name, n in (("b/x.wav", 3), ("a.wav", 5), ("b/c/d.wav", 0), ("b/note.txt", 7), ("z w.wav", 1)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    got = [(r["path"], r["length"]) for r in listing.listing(spark, str(root), "*.wav").collect()]
    assert got == [("a.wav", 5), ("b/c/d.wav", 0), ("b/x.wav", 3), ("z w.wav", 1)]
    assert all(r["modified"] or not r["length"] for r in listing.listing(spark, f"file://{root}").collect())
    plan = listing.listing(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" not in plan or "content" not in plan.split("ReadSchema")[1].split(chr(10))[0]
    d = spark.createDataFrame([(1, "a.wav", "b/x.wav"), (2, "a.wav", "gone.wav"), (3, None, "a.wav"), (4, "z w.wav", "b/c/d.wav")], "id int, kws string, cmd string")
    there, rest = listing.existing(spark, d, str(root), ["kws", "cmd"])
    assert sorted(r["id"] for r in there.collect()) == [1, 4] and sorted(r["id"] for r in rest.collect()) == [2, 3]


def packed(path, members):
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in members.items():
                z.writestr(k, v)
            z.writestr("folder/", b"")
    else:
        with tarfile.open(path, "w:gz" if path.endswith("gz") else "w") as t:
            for k, v in members.items():
                info = tarfile.TarInfo(k)
                info.size = len(v)
                t.addfile(info, io.BytesIO(v))
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_one_archive_is_read_by_several_tasks(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    members = {f"d{i % 3}/ü{i}.bin": rng.bytes(1000 + i) for i in range(40)}
    packed(f"{tmp_path}/one.{kind}", members)
    packed(f"{tmp_path}/two.{kind}", {"x": b"", "y": b"yy"})
    d = spark.read.format("archive_members").option("taskBytes", 5000).load(str(tmp_path))
    got = {(os.path.basename(r["archive"]), r["member"]): bytes(r["content"]) for r in d.collect()}
    assert got == {(f"one.{kind}", k): v for k, v in members.items()} | {(f"two.{kind}", "x"): b"", (f"two.{kind}", "y"): b"yy"}
    tasks = d.where(F.col("archive").endswith(f"one.{kind}")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 1 if kind == "tar.gz" else tasks >= 8
    with pytest.raises(Exception):
        spark.read.format("archive_members").load(f"{tmp_path}/none").count()


def test_arrays_by_rows(spark, tmp_path):
    a, b = np.arange(60, dtype=np.float32).reshape(12, 5), np.arange(4, dtype=np.int16)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "s").mkdir()
    np.save(tmp_path / "s" / "b.npy", b)
    d = spark.read.format("npy_segments").option("taskBytes", 60).load(f"file://{tmp_path}")
    got = {(os.path.basename(r["path"]), r["segment"]): r["samples"] for r in d.collect()}
    assert got == {("a.npy", i): x.tolist() for i, x in enumerate(a)} | {("b.npy", 0): b.tolist()} and d.rdd.getNumPartitions() == 5
    with pytest.raises(Exception):
        np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
        spark.read.format("npy_segments").load(str(tmp_path)).collect()


def left(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_out(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"pos/{i}.wav", [((i * k) % 7 - 3) / 4 for k in range(50)]) for i in range(12)] + [("none.wav", None), (None, [0.0])]
    d = spark.createDataFrame(rows, "name string, samples array<double>").repartition(4)
    d.write.format("wav_files").mode("append").option("rate", 8000).save(folder)
    assert left(folder) == sorted(n for n, x in rows if n and x) and os.listdir(folder) == ["pos"]
    for name, x in rows[:12]:
        got, rate = media.decode_wav(open(f"{folder}/{name}", "rb").read())
        assert rate == 8000 and np.allclose(got, x, atol=1e-4)
    for bad in ("../x.wav", "/tmp/x.wav"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad, [0.0])], d.schema).write.format("wav_files").mode("append").save(folder)
    with pytest.raises(Exception, match="one name"):
        spark.createDataFrame([("a.wav", [0.0]), ("./a.wav", [0.1])], d.schema).write.format("wav_files").mode("append").save(folder)
    assert left(folder) == sorted(n for n, x in rows if n and x)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")

    @F.udf("array<double>")
    def breaks(i):
        if i == 37:
            raise ValueError("broken row")
        return [0.1] * 10

    d = spark.range(40).repartition(4).select(F.format_string("%d.wav", "id").alias("name"), breaks("id").alias("samples"))
    with pytest.raises(Exception, match="broken row"):
        d.write.format("wav_files").mode("append").save(folder)
    assert left(folder) == []


def test_numerals_read_every_inner_zero():
    assert [digits.numeral(n) for n in (1005, 1050, 1500, 5000, 10, 110, 1010, 105, 10005, 20010, 10000, 3000003, -7, 10**8)] == [
        "一千零零五", "一千零五十", "一千五百", "五千", "十", "一百一十", "一千零一十", "一百零五", "一万五", "二万十", "一万", "三百万三", "负七", None]
