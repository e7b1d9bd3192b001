"""Folders and image files at scale: listing by rounds, and sizes from the first bytes of images."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

#: Image suffixes, compared in lower case.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")

Read = Callable[[int, int], bytes]


def opened(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below root, empty ones too; only names are read.

    Spark's file sources leave out empty files, and an empty label file is valid, so tasks list folders themselves. It goes by
    rounds: the folders that a round finds are dealt to the tasks of the next, so a deep or lopsided tree is spread over all
    tasks, and there are as many rounds as levels.
    """
    system, base = opened(root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own = opened(root)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = own.get_file_info(fs.FileSelector(folder))
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in found], pa.string()), pa.array([x.size or 0 for x in found], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())], names=["path", "length", "folder"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    folders, out = spark.createDataFrame([(base,)], "path string"), None
    while True:
        found = written(folders.repartition(n, "path").mapInArrow(listed, "path string, length long, folder boolean"))
        files = found.where("not folder").select("path", "length")
        out = files if out is None else out.unionByName(files)
        folders = found.where("folder").select("path")
        if folders.limit(1).count() == 0:
            return out


def _png(read: Read) -> tuple[int, int]:
    return struct.unpack(">II", read(16, 8))


def _bmp(read: Read) -> tuple[int, int]:
    if struct.unpack("<I", read(14, 4))[0] == 12:
        return struct.unpack("<HH", read(18, 4))
    width, height = struct.unpack("<ii", read(18, 8))
    return width, abs(height)


def _jpeg(read: Read) -> tuple[int, int]:
    """Segments are stepped over until one that starts a frame."""
    at = 2
    while True:
        head = read(at, 9)
        if len(head) < 9 and head[1:2] != b"\xff":
            raise ValueError("no frame")
        if head[0] != 0xFF:
            raise ValueError("no marker")
        marker = head[1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[5:9])
            return width, height
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]


def _tiff(read: Read) -> tuple[int, int]:
    order = "<" if read(0, 2) == b"II" else ">"
    first = struct.unpack(order + "I", read(4, 4))[0]
    n = struct.unpack(order + "H", read(first, 2))[0]
    found = {}
    entries = read(first + 2, 12 * n)
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", entries, 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entries, 12 * k + 8)[0]
    return found[256], found[257]


def _webp(read: Read) -> tuple[int, int]:
    form = read(12, 4)
    if form == b"VP8X":
        b = read(24, 6)
        return 1 + int.from_bytes(b[:3], "little"), 1 + int.from_bytes(b[3:], "little")
    if form == b"VP8L":
        bits = struct.unpack("<I", read(21, 4))[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    width, height = struct.unpack("<HH", read(26, 4))
    return width & 0x3FFF, height & 0x3FFF


def image_size(read: Read) -> tuple[int, int]:
    """(width, height) of an image, of which read(offset, n) gives bytes. The content decides, not the name."""
    head = read(0, 12)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(read)
    if head[:2] == b"\xff\xd8":
        return _jpeg(read)
    if head[:2] == b"BM":
        return _bmp(read)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(read)
    if head[:4] == b"RIFF" and head[8:] == b"WEBP":
        return _webp(read)
    raise ValueError("no known image")


def image_headers(paths: DataFrame, root: str) -> DataFrame:
    """path, width, height, problem for each path; problem is null or says why a file has no size. Only a few bytes of a file are
    read, those that hold its size."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = opened(root)[0]
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_file(path) as f:
                        width, height = image_size(lambda at, n, f=f: f.read_at(n, at))
                    rows.append((width, height, None))
                except (OSError, ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"[:200]))
            w, h, p = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.string())], names=["path", "width", "height", "problem"])

    return paths.select("path").mapInArrow(sizes, "path string, width int, height int, problem string")


def image_sizes(spark: SparkSession, root: str, cached: DataFrame | None = None) -> DataFrame:
    """path, width, height, problem of all images below root. What the cached table (path, width, height) has is taken from
    there: such files are not opened. Rows of the cache without a file stay."""
    images = all_files(spark, root).where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGE_SUFFIXES)).select("path")
    if cached is None:
        return image_headers(images, root)
    old = cached.select("path", "width", "height", F.lit(None).cast("string").alias("problem"))
    return old.unionByName(image_headers(images.join(cached.select("path"), "path", "left_anti"), root))
