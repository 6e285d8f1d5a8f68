"""Figures whose canvas is an aggregate: rows become pixels in Spark, and only pixels meet.

A scatter counts its rows by pixel, so a figure of any number of rows is at most
width x height counts. Scanlines are put together by row of pixels, and the image, whose
size is that of the canvas, in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most pixels of a canvas.
MOST = 4_000_000


def _pixel(value: Column, low: float, high: float, size: int) -> Column:
    span = high - low
    at = F.floor((value - F.lit(low)) / F.lit(span) * size) if span > 0 else F.lit(size // 2)
    return F.least(at.cast("int"), F.lit(size - 1))


def scatter(df: DataFrame, x: str, y: str, width: int = 640, height: int = 480, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """px, py (from 0, the top left) and n, the rows of each pixel that has any.

    bounds: x and y from and to; unset, the least and largest values. Rows with a null, a
    NaN or a point outside have no pixel; the upper bounds belong to the last pixels.
    """
    if width * height > MOST:
        raise ValueError(f"a canvas has at most {MOST} pixels")
    fine = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(fine(x).alias("x"), fine(y).alias("y")).where("x is not null and y is not null")
    if bounds is None:
        one = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        bounds = tuple(0.0 if v is None else float(v) for v in one)
    x0, x1, y0, y1 = map(float, bounds)
    inside = rows.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.groupBy(_pixel(F.col("x"), x0, x1, width).alias("px"), (height - 1 - _pixel(F.col("y"), y0, y1, height)).alias("py")).agg(F.count("*").alias("n"))


def boxes(table: DataFrame, group: str, width: int = 640, height: int = 480, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Pixels of box plots from rows of (group, low, q1, median, q3, high), side by side in the order of the groups.

    The table has a row a box, and a box is at most two pixels wide if there are more than
    ``width`` / 4 of them. Values outside the bounds are drawn at the edge.
    """
    names = [r[0] for r in table.select(group).distinct().orderBy(group).limit(width).collect()]
    step = width // max(1, len(names))
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group)) - 1
    at = lambda c: F.lit(height - 1) - F.greatest(F.lit(0), _pixel(F.col(c).cast("double"), float(bounds[0]), float(bounds[1]), height))
    left, half = (number * step + step // 4).cast("int"), max(1, step // 2)
    rows = table.select(left.alias("l"), (left + half).alias("r"), *[at(c).alias(c) for c in ("low", "q1", "median", "q3", "high")])
    line = lambda x, y: F.struct(x.cast("int").alias("px"), y.cast("int").alias("py"))
    across = lambda c: F.transform(F.sequence("l", "r"), lambda p: line(p, F.col(c)))
    down = lambda x, a, b: F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda p: line(x, p))
    middle = F.floor((F.col("l") + F.col("r")) / 2)
    parts = F.concat(across("q1"), across("median"), across("q3"), down(F.col("l"), "q1", "q3"), down(F.col("r"), "q1", "q3"), down(middle, "low", "q1"), down(middle, "q3", "high"))
    return rows.select(F.explode(parts).alias("p")).select("p.px", "p.py").groupBy("px", "py").agg(F.count("*").alias("n"))


def bars(table: DataFrame, label: str, value: str, width: int = 640, height: int = 480, bounds: tuple[float, float] | None = None, order: Column | None = None) -> DataFrame:
    """Pixels of one bar a label, from the line of zero to its value, side by side in ``order`` and then by label.

    A canvas holds a bar for every two pixels of its width; more labels are refused. bounds:
    from and to, zero among them; unset, the least and largest values or zero. Values
    beyond are drawn to the edge. A null label, and a null or NaN value, has no bar; a
    label on several rows has their bars on one place, and ``n`` counts them.
    """
    rows = table.withColumn("_v", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).where(F.col(label).isNotNull() & F.col("_v").isNotNull())
    places = rows.groupBy(label).agg(F.min(F.lit(0) if order is None else order).alias("_o")).orderBy("_o", label).limit(width // 2 + 1).collect()
    if len(places) > width // 2:
        raise ValueError(f"{width} pixels hold {width // 2} bars at most")
    if bounds is None:
        one = rows.agg(F.min("_v"), F.max("_v")).first()
        bounds = min(0.0, one[0] or 0.0), max(0.0, one[1] or 0.0)
    low, high = map(float, bounds)
    step = width // max(1, len(places))
    number = F.array_position(F.array(*[F.lit(r[0]) for r in places]), F.col(label)) - 1 if places else F.lit(0)
    at = lambda v: F.lit(height - 1) - F.greatest(F.lit(0), _pixel(v, low, high, height))
    left = (number * step + step // 4).cast("int")
    drawn = rows.select(left.alias("l"), at(F.col("_v")).alias("v"), at(F.lit(0.0)).alias("z"))
    drawn = drawn.select(F.explode(F.sequence(F.col("l"), F.col("l") + max(1, step // 2) - 1)).alias("px"), "v", "z")
    return drawn.select("px", F.explode(F.sequence(F.least("v", "z"), F.greatest("v", "z"))).alias("py")).groupBy("px", "py").agg(F.count("*").alias("n"))


def shade(n: np.ndarray, most: int) -> np.ndarray:
    """Grey values: 255 without rows, darker with the logarithm of their number, 0 at the largest."""
    return np.where(n > 0, np.floor(200 * (1 - np.log1p(n) / np.log1p(max(most, 1)))), 255).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels: DataFrame, width: int, height: int, name: str = "figure.png") -> DataFrame:
    """(path, content) of a grey PNG of (px, py, n), one row a pixel at most; no pixels give a blank image."""
    if width * height > MOST:
        raise ValueError(f"a canvas has at most {MOST} pixels")
    most = pixels.agg(F.max("n")).first()[0] or 1
    lines = pixels.groupBy("py").agg(F.collect_list("px").alias("px"), F.collect_list("n").alias("n"))

    def scanlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for xs, counts in zip(pdf["px"], pdf["n"]):
                line = np.zeros(width, dtype=np.int64)
                line[np.asarray(xs)] = np.asarray(counts)
                out.append(shade(line, most).tobytes())
            yield pd.DataFrame({"py": pdf["py"], "line": out})

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = dict(zip(pdf["py"], pdf["line"]))
        blank = b"\xff" * width
        raw = b"".join(b"\0" + rows.get(k, blank) for k in range(height))
        head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        content = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")
        return pd.DataFrame({"path": [name], "content": [content]})

    # a line outside the canvas stands for an image without pixels
    none = pixels.sparkSession.createDataFrame([(-1, b"")], "py int, line binary")
    return lines.mapInPandas(scanlines, "py int, line binary").unionByName(none).groupBy().applyInPandas(lambda pdf: image(pdf), "path string, content binary")


def write_files(files: DataFrame, folder: str) -> list[str]:
    """Write (path, content) rows, of bounded size each, into a folder of any store that Spark reaches; one at a time."""
    spark, out = files.sparkSession, []
    for r in files.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r['path']}")
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            stream.write(bytearray(r["content"]))
        finally:
            stream.close()
        out.append(path.toString())
    return out
