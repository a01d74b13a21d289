"""Page sources: folder scans, pixels, natural order, registration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.scale import first_per_group

# Page file extensions.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")


def scan_pages(spark: SparkSession, path: str, exts: Sequence[str] = IMAGE_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """Readable pages under a folder, and the files that could not be read.

    Extensions match in any case. The image source reads only matching files.
    """
    def either(e):
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    glob = "*.{" + ",".join(either(e) for e in exts) + "}"
    img = (spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
           .option("dropInvalid", False).load(path))
    rows = img.select(F.col("image.origin").alias("path"), "image")
    return rows.where("image.nChannels > 0"), rows.where("image.nChannels <= 0").select("path")


#: Header of a raw page raster: kind (5 grey, 6 colour), width, height, largest value; comments run to the end of a line.
RASTER_HEADER = rb"P([56])\s(?:\s*#[^\n]*\n)*\s*(\d{1,9})\s(?:\s*#[^\n]*\n)*\s*(\d{1,9})\s(?:\s*#[^\n]*\n)*\s*(\d{1,5})\s"


#: Pixels that meet in one task when pages are packed.
PACK_PIXELS = 500_000


def read_rasters(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Pages of raw raster containers (binary PGM and PPM, one image after another): path, nth, image; and what could not be read.

    ``files`` comes from ``spark.read.format("binaryFile")`` or any table with bytes, so every store that Spark reads will do.
    ``image`` has the columns of Spark's image source (blue, green, red). A broken image ends its container: what
    came before is kept, and the rest is one row of path, nth and reason.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        header = re.compile(RASTER_HEADER)
        names = ["path", "nth", "height", "width", "nChannels", "data", "reason"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, nth = memoryview(body.as_buffer() if body.is_valid else b""), 0, 0
                while at < len(data) or nth == 0:
                    m = header.match(data[at:at + 4096])
                    row, reason = None, None
                    if not m:
                        reason = "no raster"
                    elif int(m[4]) != 255:
                        reason = "not 8 bits"
                    else:
                        c, w, h = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3])
                        start = at + m.end()
                        if w * h == 0 or start + w * h * c > len(data):
                            reason = "cut short"
                        else:
                            pixels = np.frombuffer(data[start:start + w * h * c], np.uint8).reshape(h, w, c)[..., ::-1]
                            row = (h, w, c, pixels.tobytes())
                            at = start + w * h * c
                    values = [name, nth, *(row or (None,) * 4), reason]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds)], names=names)
                    nth += 1
                    if reason:
                        break
    rows = files.select(F.col(path).cast("string"), F.col(content)).mapInArrow(
        run, "path string, nth int, height int, width int, nChannels int, data binary, reason string")
    image = F.struct(F.col("path").alias("origin"), "height", "width", "nChannels", F.lit(16).alias("mode"), "data")
    return rows.where("reason IS NULL").select("path", "nth", image.alias("image")), rows.where("reason IS NOT NULL").select("path", "nth", "reason")


def pack_pixels(px: DataFrame, width: int, height: int, page_id: str = "page_id") -> DataFrame:
    """Inverse of ``explode_pixels``: page_id and image; pixels that are missing are black. A page is one image, so its pixels meet in one row.

    Pages are dealt over as many tasks as there are slices of ``PACK_PIXELS`` pixels, so a task holds about that many, or one page.
    Gaps are filled while a page is written; no grid of all places is made.
    """
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    place = F.when(inside, F.col("y").cast("long") * width + F.col("x")).alias("__at")
    tasks = max(px.sparkSession.sparkContext.defaultParallelism, -(-px.select(page_id).count() // PACK_PIXELS))
    dealt = px.select(page_id, place, "b", "g", "r").repartition(tasks, page_id)
    one = dealt.groupBy(page_id, "__at").agg(*[F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(c) for c in "bgr"])
    pixel = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "bgr"])
    spot = F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), pixel.alias("bgr")))
    rows = one.groupBy(page_id).agg(F.array_sort(F.collect_list(spot)).alias("__p"))
    before = lambda i: F.coalesce(F.get("__p", i - 1)["at"], F.lit(-1))
    filled = F.transform("__p", lambda v, i: F.concat(F.repeat(F.lit("000000"), (v["at"] - before(i) - 1).cast("int")), v["bgr"]))
    data = F.unhex(F.rpad(F.array_join(filled, ""), width * height * 6, "0"))
    image = F.struct(F.lit("").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return rows.select(page_id, image.alias("image"))


def explode_pixels(pages: DataFrame, page_id: str = "page_id", stride: int = 1) -> DataFrame:
    """One row per (sampled) pixel: page_id, x, y, gray, r, g, b. No shuffle.

    Rows leave in slices of at most about a million pixels, whatever the page size.
    """
    key = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i in range(batch.num_rows):
                h, w, c = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                data = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint8).reshape(h, w, c)
                data = data[::stride, ::stride]
                rows = max(1, 1_000_000 // max(1, data.shape[1]))
                for y0 in range(0, data.shape[0], rows):
                    part = data[y0:y0 + rows].astype(np.int32)
                    yy, xx = np.mgrid[y0:y0 + part.shape[0], 0:part.shape[1]]
                    b, g, r = (part[..., k] if c >= 3 else part[..., 0] for k in (0, 1, 2))
                    gray = (299 * r + 587 * g + 114 * b + 500) // 1000
                    n = xx.size
                    cols = [pa.array([ids[i].as_py()] * n, type=ids.type)]
                    cols += [pa.array(v.ravel().astype(np.int32)) for v in (xx * stride, yy * stride, gray, r, g, b)]
                    yield pa.RecordBatch.from_arrays(cols, names=[page_id, "x", "y", "gray", "r", "g", "b"])
    flat = pages.select(page_id, "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInArrow(run, f"{page_id} {key}, x int, y int, gray int, r int, g int, b int")


def folder_of(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_of(path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def natural_key(name: Column) -> Column:
    """Array key that puts page2 before page10: numbers by value, text case-folded."""
    def part(p):
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)) \
            .otherwise(F.concat(F.lit("1"), F.lower(p)))
    return F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), part)


def natural_order(df: DataFrame, path_col: str) -> DataFrame:
    """Sort by folder, then naturally by file name (a range-partitioned sort)."""
    p = F.col(path_col)
    d = df.withColumns({"folder": folder_of(p), "natural_key": natural_key(file_of(p))})
    return d.orderBy("folder", "natural_key", path_col)


def register_new(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows whose key is not known yet; the first occurrence of a key wins."""
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti")
    return first_per_group(fresh, [key], [order], 1).select(*incoming.columns)


def remove_pages(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti")
