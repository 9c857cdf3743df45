import io
import math
import os
import struct
import tempfile
import zipfile

import pytest

from stratolith.sources import shapefile as s


def ring(x, y, w):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]


DDL = f"gid long, st string, share double, geom {s.GEOMETRY}"


def test_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(1, "ca", 0.5, [[ring(0, 0, 3), ring(1, 1, 1)], [ring(10, 10, 1)]]), (2, None, None, None), (None, "é", -2.0, [[ring(5, 5, 2)]])]
    written = s.write_zipped(spark.createDataFrame(rows, DDL).coalesce(1), "file://" + folder).collect()
    assert sum(r.rows for r in written) == 3
    back = s.read_zipped(spark, "file://" + folder)
    assert back.schema.simpleString() == "struct<gid:bigint,st:string,share:double,geom:array<array<array<struct<x:double,y:double>>>>>"
    got = {r.gid: r for r in back.collect()}
    assert got[2].geom is None and got[2].share is None and got[None].st == "é" and got[None].share == -2.0
    assert [[len(r) for r in part] for part in got[1].geom] == [[5, 5], [5]]
    assert {(p.x, p.y) for p in got[1].geom[0][1]} == {(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)}


def test_no_packages_and_other_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(folder + "/notes.txt", "w") as out:
        out.write("x")
    assert s.read_zipped(spark, "file://" + folder).columns == ["geom"] and s.read_zipped(spark, "file://" + folder).count() == 0


def test_appends_missing_columns_and_deleted_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-")

    def put(name, field, value, flag):
        line = struct.pack("<i4d2i2i", 3, 0, 0, 1, 1, 2, 3, 0, 2) + struct.pack("<6d", 0, 0, 1, 1, 5, 5)
        shp = struct.pack(">i20xi", 9994, 0) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
        shp += 2 * (struct.pack(">2i", 1, len(line) // 2) + line)
        dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, 2, 65, 5) + struct.pack("<11sc4xBB14x", field, b"C", 4, 0) + b"\r"
        dbf += b" " + value.ljust(4) + flag + b"gone"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("r.SHP", shp)
            z.writestr("r.DBF", dbf)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(out.getvalue())

    put("tl_a.zip", b"GEOID", b"0601", b"*")
    put("tl_b.zip", b"OTHER", b"x", b" ")
    put("skip.zip", b"GEOID", b"9", b"*")
    got = s.read_zipped(spark, "file://" + folder, r"^tl_.*\.zip$").collect()
    assert sorted((r.geoid or "") for r in got) == ["", "", "0601"]
    assert [len(part[0]) for part in got[0].geom] == [2, 1]


def test_index_and_coordinate_system(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, "x", 0.0, [[ring(i * 1000, 20037508 / 4, 1000)]]) for i in range(5)]
    s.write_zipped(spark.createDataFrame(rows, DDL).coalesce(1), "file://" + folder, system=3857).collect()
    back = s.read_zipped(spark, "file://" + folder).orderBy("gid").collect()
    x, y = math.degrees(1000 / s.EARTH_RADIUS), math.degrees(2 * math.atan(math.exp(20037508 / 4 / s.EARTH_RADIUS)) - math.pi / 2)
    assert min(p.x for p in back[1].geom[0][0]) == pytest.approx(x) and min(p.y for p in back[1].geom[0][0]) == pytest.approx(y)
    with zipfile.ZipFile(f"{folder}/{[f for f in os.listdir(folder) if f.endswith('.zip')][0]}") as z:
        shp, shx = z.read("shapes.shp"), z.read("shapes.shx")
        assert "Mercator" in z.read("shapes.prj").decode()
    assert len(shx) == 100 + 8 * 5 and struct.unpack_from(">i", shx, 24)[0] * 2 == len(shx)
    for i in range(5):
        at, words = struct.unpack_from(">2i", shx, 100 + 8 * i)
        assert struct.unpack_from(">2i", shp, 2 * at) == (i + 1, words)


def put(path, rows, method=zipfile.ZIP_DEFLATED, turned=False, index=True, past=0):
    """A package with ``rows`` squares; ``turned``: its records lie in the other order; ``past``: bytes that the index says too many."""
    import pyarrow as pa

    data = s._package(["gid", "st"], [pa.array(range(rows), pa.int64()), pa.array(["x"] * rows, pa.string())], [[[ring(i, i, 1)]] for i in range(rows)], 4326)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    shp, shx = parts["shapes.shp"], parts["shapes.shx"]
    records = [shp[2 * at : 2 * at + 8 + 2 * words] for at, words in struct.iter_unpack(">2i", shx[100:])]
    if turned:
        parts["shapes.shp"] = shp[:100] + b"".join(records[::-1])
        ends = [100 + sum(map(len, records[i + 1 :])) for i in range(rows)]
        parts["shapes.shx"] = shx[:100] + b"".join(struct.pack(">2i", at // 2, (len(r) - 8) // 2) for at, r in zip(ends, records, strict=True))
    if past:
        parts["shapes.shx"] = shx[:-4] + struct.pack(">i", struct.unpack(">i", shx[-4:])[0] + past // 2)
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in parts.items():
            if index or not name.endswith(".shx"):
                z.writestr(name, content)


@pytest.mark.parametrize("form", [{}, {"method": zipfile.ZIP_STORED}, {"turned": True}, {"index": False}, {"index": False, "method": zipfile.ZIP_STORED}])
def test_ranges_of_records(spark, form):
    folder = tempfile.mkdtemp(prefix="spark-") + "/a b%20c"
    os.mkdir(folder)
    put(folder + "/p.zip", 50, **form)
    splits = s.splits_of(spark, folder, split=1000).collect()
    assert sum(r.n for r in splits) == 50 and all(r.shapes_bytes <= 1000 for r in splits) and len(splits) >= 8
    assert all(r.shapes.endswith("/p.zip") == (form.get("method") == zipfile.ZIP_STORED) for r in splits)
    back = s.read_zipped(spark, folder, split=1000)
    assert back.rdd.getNumPartitions() == min(len(splits), int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert {(r.gid, r.st, r.geom[0][0][0].x, len(r.geom[0][0])) for r in back.collect()} == {(i, "x", float(i), 5) for i in range(50)}


def test_many_tasks_read_one_package(spark):
    from pyspark.sql import functions as F

    folder = tempfile.mkdtemp(prefix="spark-")
    put(folder + "/p.zip", 5000)
    found = s.read_zipped(spark, folder, split=20_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(found) == 4 and sum(r["count"] for r in found) == 5000 and max(r["count"] for r in found) < 2000


def test_packages_named_by_a_column(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, "ab#"[i % 3], [[ring(i, i, 1)]]) for i in range(30)] + [(30, None, None)]
    written = s.write_zipped(spark.createDataFrame(rows, f"gid long, name string, geom {s.GEOMETRY}").repartition(3), folder, named="name").collect()
    assert sum(r.rows for r in written) == 31 and {os.path.basename(r.path).rpartition("_")[0] for r in written} == {"a", "b", "#", ""}
    assert {r.gid for r in s.read_zipped(spark, folder, "^#_").collect()} == {i for i in range(30) if i % 3 == 2}
    assert s.read_zipped(spark, folder).columns == ["gid", "geom"] and s.read_zipped(spark, folder).count() == 31


def test_empty_package_and_broken_index(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    put(folder + "/none.zip", 0)
    put(folder + "/some.zip", 3)
    empty = s.read_zipped(spark, folder, "none")
    assert empty.columns == ["gid", "st", "geom"] and empty.count() == 0
    assert s.read_zipped(spark, folder).count() == 3
    put(folder + "/broken.zip", 3, past=8)
    with pytest.raises(Exception, match="record 2 ends at byte"):
        s.read_zipped(spark, folder, "broken")


def test_shapes_as_arrays():
    shapes = [None, [], [[[(0.0, 1.0), (2.0, 3.0)], []], [[(4.0, 5.0)]]], None]
    got = s._geometry(shapes).to_pylist()
    assert got == [None, [], [[[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}], []], [[{"x": 4.0, "y": 5.0}]]], None]
    assert s._geometry([]).to_pylist() == [] and s._geometry([None]).to_pylist() == [None]


def test_many_rows_take_linear_time(spark):
    import time

    folder, n = tempfile.mkdtemp(prefix="spark-"), 20_000
    begun = time.time()
    put(folder + "/p.zip", n)
    assert s.read_zipped(spark, folder).count() == n and time.time() - begun < 20
    many = [[ring(i, 0, 1) for i in range(5000)]]
    assert len(s._shape(many)) > 5000 * 80 and time.time() - begun < 25
