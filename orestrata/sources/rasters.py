"""Rasters as files: a Python data source over folders of TIFF files, each of which holds some rows of a raster.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").load(path)                       # row_id, col_id, z
    write_raster(pixels, path, frame)

A raster is read strip by strip, so a task holds one strip, and written by blocks of
rows, a file each, so nothing passes through one task. Files are opened with the file systems that Arrow
knows. What a write leaves out is as if it had never begun: the list of its files is put there at the end.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

INDEX = "raster.json"
#: TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, FORMAT, TRANSFORM, NO_DATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339, 34264, 42113
SHORT, LONG, DOUBLE, ASCII = 3, 4, 12, 2
_KIND = {SHORT: "H", LONG: "I", DOUBLE: "d", ASCII: "s"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def encoded(rows: np.ndarray, frame: tuple[float, ...], strip: int = 64) -> bytes:
    """A TIFF file of one band of 32-bit floats, compressed by strips. ``frame``: a, b, c, d, e, f of :class:`orestrata.operators.warp.Frame`; what isn't a number is there as such."""
    h, w = rows.shape
    strips = [zlib.compress(np.ascontiguousarray(rows[i : i + strip], dtype="<f4").tobytes()) for i in range(0, h, strip)]
    a, b, c, d, e, f = frame
    matrix = (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    n = len(strips)
    tags = [
        (WIDTH, LONG, (w,)), (HEIGHT, LONG, (h,)), (BITS, SHORT, (32,)), (COMPRESSION, SHORT, (DEFLATE,)), (PHOTOMETRIC, SHORT, (1,)), (OFFSETS, LONG, (0,) * n), (SAMPLES, SHORT, (1,)),
        (STRIP_ROWS, LONG, (strip,)), (COUNTS, LONG, tuple(map(len, strips))), (FORMAT, SHORT, (3,)), (TRANSFORM, DOUBLE, matrix), (NO_DATA, ASCII, (b"nan\x00",)),
    ]
    place = 8 + 2 + 12 * len(tags) + 4  # of what doesn't fit into a tag
    size = sum(x for t in tags if (x := _size(t)) > 4)
    ends = np.cumsum([place + size + (place + size) % 2, *map(len, strips)]).tolist()
    tags[5] = (OFFSETS, LONG, tuple(ends[:-1]))
    head, more = [struct.pack("<2sHIH", b"II", 42, 8, len(tags))], b""
    for tag, kind, values in tags:
        raw = _packed(kind, values)
        if len(raw) > 4:
            where, more = struct.pack("<I", place + len(more)), more + raw
        else:
            where = raw.ljust(4, b"\0")
        head.append(struct.pack("<HHI", tag, kind, len(values[0]) if kind == ASCII else len(values)) + where)
    body = b"".join(head) + struct.pack("<I", 0) + more
    return body.ljust(ends[0], b"\0") + b"".join(strips)


def _packed(kind: int, values: tuple) -> bytes:
    return values[0] if kind == ASCII else struct.pack(f"<{len(values)}{_KIND[kind]}", *values)


def _size(tag: tuple) -> int:
    return len(_packed(tag[1], tag[2]))


def header(read) -> dict[int, tuple]:
    """The tags of a TIFF file; ``read`` gives bytes by place and number."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None or struct.unpack(order + "H", read(2, 2))[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", read(4, 4))
    (n,) = struct.unpack(order + "H", read(at, 2))
    tags: dict[int, tuple] = {0: (order,)}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", read(at + 2 + 12 * i, 8))
        if kind not in _KIND:
            continue
        size = count * struct.calcsize(_KIND[kind] if kind != ASCII else "c")
        place = at + 2 + 12 * i + 8
        raw = read(place, size) if size <= 4 else read(struct.unpack(order + "I", read(place, 4))[0], size)
        tags[tag] = (raw,) if kind == ASCII else struct.unpack(f"{order}{count}{_KIND[kind]}", raw)
    return tags


def frame_of(tags: dict[int, tuple]) -> tuple[float, ...] | None:
    m = tags.get(TRANSFORM)
    return (m[0], m[1], m[3], m[4], m[5], m[7]) if m else None


def strip_rows(tags: dict[int, tuple], k: int, raw: bytes) -> np.ndarray:
    """The pixels of strip ``k`` from its bytes."""
    h, w, per = tags[HEIGHT][0], tags[WIDTH][0], tags.get(STRIP_ROWS, tags[HEIGHT])[0]
    packing, bits, form = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    if packing not in (PLAIN, DEFLATE, OLD_DEFLATE) or tags.get(SAMPLES, (1,))[0] != 1 or (form, bits) not in {(1, 8), (1, 16), (1, 32), (2, 16), (2, 32), (3, 32), (3, 64)}:
        raise ValueError("only single bands of whole numbers or floats, plain or deflated, are read")
    if packing != PLAIN:
        raw = zlib.decompress(raw)
    kind = np.dtype(f"{tags[0][0]}{'uif'[form - 1]}{bits // 8}")
    n = min(per, h - k * per)
    return np.frombuffer(raw, dtype=kind, count=n * w).reshape(n, w)


@dataclass
class Strip(InputPartition):
    path: str
    row: int
    strip: int


class RasterSource(DataSource):
    """Read: ``path`` is a TIFF file or a folder that was written by this source. Write: rows of one block of rows stand together (:func:`write_raster`)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "row_id int, col_id int, z double"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RasterWriter(self.options["path"], json.loads(self.options["frame"]), int(self.options.get("block", 256)), overwrite)


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Strip]:
        """A strip each. Only the headers of the files are read for them."""
        at, path = _at(self.path)
        if at.get_file_info(path).type == fs.FileType.Directory:
            files = [(f"{path}/{f['file']}", f["row"]) for f in json.loads(at.open_input_file(f"{path}/{INDEX}").read())["files"]]
        else:
            files = [(path, 0)]
        return [Strip(f, row, k) for f, row in files for k in range(len(self._tags(at, f)[OFFSETS]))]

    @staticmethod
    def _tags(at: fs.FileSystem, path: str) -> dict[int, tuple]:
        with at.open_input_file(path) as f:
            return header(lambda place, n: f.read_at(n, place))

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        at, _ = _at(self.path)
        with at.open_input_file(partition.path) as f:
            tags = header(lambda place, n: f.read_at(n, place))
            z = strip_rows(tags, partition.strip, f.read_at(tags[COUNTS][partition.strip], tags[OFFSETS][partition.strip])).astype(float)
        h, w = z.shape
        first = partition.row + partition.strip * tags.get(STRIP_ROWS, tags[HEIGHT])[0]
        rows = np.repeat(np.arange(first, first + h, dtype=np.int32), w)
        there = ~np.isnan(z.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(rows[there]), pa.array(np.tile(np.arange(w, dtype=np.int32), h)[there]), pa.array(z.ravel()[there])], names=["row_id", "col_id", "z"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class RasterWriter(DataSourceWriter):
    def __init__(self, path: str, frame: dict, block: int, overwrite: bool):
        self.path, self.frame, self.block, self.overwrite, self.run = path, frame, block, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> Written:
        at, path = _at(self.path)
        at.create_dir(path)
        files, now, pixels = [], None, []

        def close() -> None:
            z = np.full((min(self.block, self.frame["height"] - now * self.block), self.frame["width"]), np.nan, dtype=np.float32)
            r, c, v = (np.array(x) for x in zip(*pixels))
            z[r.astype(int) - now * self.block, c.astype(int)] = v.astype(float)
            a, b, x, d, e, y = self.frame["frame"]
            name = f"rows-{now:08d}-{self.run}.tif"
            with at.open_output_stream(f"{path}/{name}") as out:
                out.write(encoded(z, (a, b, x + b * now * self.block, d, e, y + e * now * self.block)))
            files.append({"file": name, "row": now * self.block})

        for row in iterator:
            k = row[0] // self.block
            if k != now:
                if pixels:
                    close()
                now, pixels = k, []
            pixels.append((row[0], row[1], np.nan if row[2] is None else row[2]))
        if pixels:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """The list of files makes the raster. An older raster's files go only then."""
        at, path = _at(self.path)
        at.create_dir(path)
        old = at.get_file_info(f"{path}/{INDEX}").type == fs.FileType.File
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds a raster")
        gone = json.loads(at.open_input_file(f"{path}/{INDEX}").read())["files"] if old else []
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["row"])
        with at.open_output_stream(f"{path}/{INDEX}") as out:
            out.write(json.dumps(self.frame | {"files": files}).encode())
        for f in gone:
            at.delete_file(f"{path}/{f['file']}")

    def abort(self, messages: list) -> None:
        at, path = _at(self.path)
        for m in messages:
            for f in m.files if m else []:
                at.delete_file(f"{path}/{f['file']}")


def write_raster(pixels: DataFrame, path: str, frame: tuple[float, ...], height: int, width: int, column: str = "z", block: int = 256, mode: str = "append") -> None:
    """``row_id, col_id`` and a value of each pixel as files of ``block`` rows each; pixels that aren't there are no number. ``mode``: append (to nothing) or overwrite."""
    told = json.dumps({"frame": list(frame), "height": height, "width": width})
    pixels.sparkSession.dataSource.register(RasterSource)
    d = pixels.select(F.col("row_id").cast("int").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), F.col(column).cast("double").alias("z"))
    d = d.repartition(F.floor(F.col("row_id") / block)).sortWithinPartitions("row_id")
    d.write.format("raster").option("frame", told).option("block", block).mode(mode).save(path)


def raster_frame(path: str) -> tuple[tuple[float, ...], int, int]:
    """Frame, height and width of a raster that was written here."""
    at, p = _at(path)
    told = json.loads(at.open_input_file(f"{p}/{INDEX}").read())
    return tuple(told["frame"]), told["height"], told["width"]
