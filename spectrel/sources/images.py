"""Image sink: a TIFF file whose strips are encoded in tasks, on any path that Spark can write."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.runtime import ship, written

ROWS = 64
#: Tags and types of the public format (fixed values): width, height, bits, compression (deflate), meaning of the samples, strip offsets,
#: samples a pixel, rows a strip, strip sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, STRIP_ROWS, SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
SHORT, LONG = 3, 4
DEFLATE, GRAY, RGB = 8, 1, 2


def _head(height: int, width: int, samples: int, sizes: list[int]) -> bytes:
    """Everything before the strips: the header, the directory, and the values that don't fit in it."""
    tags = [
        (WIDTH, LONG, [width]), (HEIGHT, LONG, [height]), (BITS, SHORT, [8] * samples), (COMPRESSION, SHORT, [DEFLATE]), (MEANING, SHORT, [GRAY if samples == 1 else RGB]),
        (OFFSETS, LONG, [0] * len(sizes)), (SAMPLES, SHORT, [samples]), (STRIP_ROWS, LONG, [ROWS]), (SIZES, LONG, sizes),
    ]
    code = {SHORT: "H", LONG: "I"}
    body = lambda kind, values: struct.pack(f"<{len(values)}{code[kind]}", *values)
    start = 8 + 2 + 12 * len(tags) + 4
    first = start + sum(len(b) + len(b) % 2 for kind, values in ((k, v) for _, k, v in tags) if len(b := body(kind, values)) > 4)
    if first + sum(sizes) >= 1 << 32:
        raise ValueError("the image is too large for the format")
    tags[5] = (OFFSETS, LONG, [first + int(x) for x in np.cumsum([0, *sizes[:-1]])])
    entries, more = b"", b""
    for tag, kind, values in tags:
        data = body(kind, values)
        entries += struct.pack("<HHI", tag, kind, len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", start + len(more)))
        more += (data + b"\0" * (len(data) % 2)) if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + more


def write_image(pixels: DataFrame, path: str, height: int, width: int, columns: tuple[str, ...] = ("value",)) -> None:
    """Write whole numbers from 0 to 255 as an image file: one column of gray or three of red, green and blue; pixels that are not there are 0.

    Tasks encode strips of ``ROWS`` lines; the driver then puts these one after the other, holding one at a time, into a file beside
    ``path`` that takes its name at the end, in place of one that is there. No pixels, one outside the image, one that is given twice, or a value out
    of range is an error, which leaves no new file.
    """
    spark, samples = pixels.sparkSession, len(columns)
    ship(spark)
    if samples not in (1, 3):
        raise ValueError("one or three columns are needed")

    def encode(table: pa.Table) -> pa.Table:
        strip = table["strip"][0].as_py()
        y, x = table["y"].to_numpy() - strip * ROWS, table["x"].to_numpy()
        values = np.column_stack([table[f"c{i}"].to_numpy() for i in range(samples)])
        at = y * width + x
        if (table["y"].to_numpy() >= height).any() or (x < 0).any() or (x >= width).any():
            raise ValueError("a pixel is outside the image")
        if len(np.unique(at)) < len(at):
            raise ValueError("a pixel is given twice")
        if (values < 0).any() or (values > 255).any():
            raise ValueError("a value is not from 0 to 255")
        out = np.zeros((min(ROWS, height - strip * ROWS) * width, samples), np.uint8)
        out[at] = values
        return pa.table({"strip": pa.array([strip], pa.int32()), "data": pa.array([zlib.compress(out.tobytes())], pa.binary())})

    rows = pixels.select(F.floor(F.col("y") / ROWS).cast("int").alias("strip"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(columns)])
    made = written(rows.groupBy("strip").applyInArrow(encode, "strip int, data binary"))
    sizes = {r.strip: r.n for r in made.select("strip", F.length("data").alias("n")).collect()}
    if not sizes:
        raise ValueError("there is no image to write")
    if min(sizes) < 0:
        raise ValueError("a pixel is outside the image")
    count = -(-height // ROWS)
    empty = {i: zlib.compress(bytes(min(ROWS, height - i * ROWS) * width * samples)) for i in range(count) if i not in sizes}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".writing"))
    files = target.getFileSystem(conf)
    out = files.create(beside, True)
    try:
        out.write(bytearray(_head(height, width, samples, [sizes.get(i) or len(empty[i]) for i in range(count)])))
        have, row = made.orderBy("strip").toLocalIterator(), None
        for i in range(count):
            if i in empty:
                out.write(bytearray(empty[i]))
            else:
                row = next(have)
                out.write(bytearray(row.data))
        out.close()
    except BaseException:
        out.close()
        files.delete(beside, False)
        raise
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"{path} could not be written")
