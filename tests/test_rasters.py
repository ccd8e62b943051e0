"""Rasters written and read back, other writers' layouts, and writes that fail."""

import os
import struct
import zlib

import numpy as np
import pytest

from orestrata.sources import rasters


def table(spark, z, holes=()):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1]) if (r, c) not in holes], "row_id int, col_id int, z double")


def test_round_trip(spark, tmp_path):
    z = np.random.default_rng(4).normal(size=(150, 37)).astype(np.float32)
    holes = {(0, 0), (149, 36), (70, 5)}
    path, frame = f"{tmp_path}/r", (30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0)
    rasters.write_raster(table(spark, z, holes).repartition(5), path, frame, 150, 37, block=40)
    assert rasters.raster_frame(path) == (frame, 150, 37)
    d = spark.read.format("raster").load(path)
    got = {(r.row_id, r.col_id): r.z for r in d.collect()}
    assert got == {(r, c): float(z[r, c]) for r in range(150) for c in range(37) if (r, c) not in holes}
    assert d.rdd.getNumPartitions() == 4 and len([f for f in os.listdir(path) if f.endswith(".tif")]) == 4
    # A single file of it is a raster too, with its own frame.
    name = sorted(f for f in os.listdir(path) if f.endswith(".tif"))[1]
    assert spark.read.format("raster").load(f"{path}/{name}").count() == 40 * 37 - 1
    raw = open(f"{path}/{name}", "rb").read()
    assert rasters.frame_of(rasters.header(lambda at, n: raw[at : at + n])) == (30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0 - 30 * 40)


def test_writing_again(spark, tmp_path):
    path, frame = f"{tmp_path}/r", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    rasters.write_raster(table(spark, np.ones((5, 4))), path, frame, 5, 4, block=2)
    with pytest.raises(Exception, match="holds a raster"):
        rasters.write_raster(table(spark, np.zeros((5, 4))), path, frame, 5, 4, block=2)
    assert spark.read.format("raster").load(path).where("z = 1").count() == 20 and len(os.listdir(path)) == 4
    rasters.write_raster(table(spark, np.zeros((3, 4))), path, frame, 3, 4, block=2, mode="overwrite")
    assert spark.read.format("raster").load(path).where("z = 0").count() == 12 and len(os.listdir(path)) == 3


@pytest.mark.parametrize("order,kind,form,packing", [("<", "u1", 1, 1), (">", "i2", 2, 1), (">", "f4", 3, 8), ("<", "f8", 3, 32946)])
def test_other_layouts(spark, tmp_path, order, kind, form, packing):
    """Files with other byte orders, numbers and packings, laid out by hand."""
    z = np.arange(35).reshape(7, 5)
    strips = [np.ascontiguousarray(z[i : i + 3], dtype=order + kind).tobytes() for i in (0, 3, 6)]
    strips = [zlib.compress(s) if packing != 1 else s for s in strips]
    tags = [(256, 3, [5]), (257, 3, [7]), (258, 3, [8 * np.dtype(kind).itemsize]), (259, 3, [packing]), (273, 4, None), (277, 3, [1]), (278, 3, [3]), (279, 4, [len(s) for s in strips]), (339, 3, [form])]
    size = 8 + 2 + 12 * len(tags) + 4
    at = size + 24
    tags[4] = (273, 4, [at, at + len(strips[0]), at + len(strips[0]) + len(strips[1])])
    out, more = struct.pack(order + "2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(tags)), b""
    for tag, k, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if k == 3 else 'I'}", *values)
        where = raw.ljust(4, b"\0")
        if len(raw) > 4:
            where, more = struct.pack(order + "I", size + len(more)), more + raw
        out += struct.pack(order + "HHI", tag, k, len(values)) + where
    path = f"{tmp_path}/a.tif"
    open(path, "wb").write(out + struct.pack(order + "I", 0) + more + b"".join(strips))
    spark.dataSource.register(rasters.RasterSource)
    got = {(r.row_id, r.col_id): r.z for r in spark.read.format("raster").load(path).collect()}
    assert got == {(r, c): float(z[r, c]) for r in range(7) for c in range(5)}


def test_files_that_are_no_rasters(tmp_path):
    with pytest.raises(ValueError, match="not a TIFF"):
        rasters.header(lambda at, n: b"%PDF-1.4"[at : at + n])
