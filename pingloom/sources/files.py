"""Files as tables: rasters, ping rows, JSON lines, COCO annotations, checksums."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _png(width: int, height: int, channels: int, samples: bytes) -> bytes:
    """A PNG file of 8-bit samples, row by row."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    size = width * channels
    body = b"".join(b"\0" + samples[r * size : (r + 1) * size] for r in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _write_each(rows: DataFrame, path: str, content: Callable[[dict], bytes], folders: int = 0) -> int:
    """A file named ``name`` under ``path`` for each row; tasks write their own files, and the same ones if they run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, folder = fs.FileSystem.from_uri(path)
        target.create_dir(folder, recursive=True)
        made = set()
        for b in batches:
            for r in b.to_pylist():
                at = f"{folder}/{_folder(r['name'], folders)}" if folders else folder
                if folders and at not in made:
                    target.create_dir(at, recursive=True)
                    made.add(at)
                with target.open_output_stream(f"{at}/{r['name']}") as out:
                    out.write(content(r))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_rasters(images: DataFrame, path: str) -> int:
    """Write images (name, width, height, channels 1 or 3, samples, damaged) as PNG files; gives their number. A ``damaged`` file ends in the middle."""

    def content(r: dict) -> bytes:
        data = _png(r["width"], r["height"], r["channels"], bytes(r["samples"]))
        return data[: len(data) // 2] if r["damaged"] else data

    return _write_each(images.select("name", "width", "height", "channels", "samples", "damaged"), path, content)


def write_texts(rows: DataFrame, path: str, folders: int = 0) -> int:
    """Write rows (name, text) as UTF-8 files that end in a line feed, empty ones for empty or null texts; gives their number.

    ``folders``: files are dealt to so many folders by their names, or all lie in one.
    """
    return _write_each(rows.select("name", "text"), path, lambda r: f"{r['text']}\n".encode() if r["text"] else b"", folders)


def _folder(name: str, folders: int) -> str:
    return f"{zlib.crc32(name.encode()) % folders:06d}"


def read_texts(spark: SparkSession, path: str, folders: int = 0) -> DataFrame:
    """``name, text`` of the files that ``write_texts`` wrote; with ``folders``, tasks list these, and the driver holds no name."""
    if folders:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, top = fs.FileSystem.from_uri(path)
            for k in (k for b in batches for k in b.column("id").to_pylist()):
                found = [x for x in source.get_file_info(fs.FileSelector(f"{top}/{k:06d}", allow_not_found=True)) if x.is_file]
                for i in range(0, len(found), 1024):
                    texts = []
                    for x in found[i : i + 1024]:
                        with source.open_input_stream(x.path) as f:
                            texts.append(f.read().decode().removesuffix("\n"))
                    yield pa.RecordBatch.from_arrays([pa.array([x.base_name for x in found[i : i + 1024]], pa.string()), pa.array(texts, pa.string())], names=["name", "text"])

        return spark.range(0, folders, 1, min(folders, 64)).mapInArrow(run, "name string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "\n$", "").alias("text"))


def scan_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``path, raster_sha256, width, height, channels, identity`` of image files; those that cannot be read stay, with null sizes and identity."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("raster_sha256"))
    seen = spark.read.format("image").option("dropInvalid", True).load(path).select(F.regexp_replace("image.origin", "^file:/+", "/").alias("o"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))
    out = raw.join(seen, F.regexp_replace("path", "^file:/+", "/") == F.col("o"), "left").drop("o")
    return out.withColumn("identity", F.when(F.col("width").isNotNull(), F.col("raster_sha256")))


def explode_ping_rows(spark: SparkSession, path: str) -> DataFrame:
    """``frame, row_idx, digest, samples``: one row for each raster row (the first channel; colour bytes are BGR)."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select(F.element_at(F.split("image.origin", "/"), -1).alias("frame"), "image.width", "image.height", "image.nChannels", "image.data")
    rows = i.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring(F.col("data"), F.col("row_idx") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels"))
    rows = rows.select("frame", "row_idx", "width", "nChannels", line.alias("line"))
    sample = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.conv(F.hex(F.substring(F.col("line"), x * F.col("nChannels") + 1, F.lit(1))), 16, 10).cast("int"))
    return rows.select("frame", "row_idx", F.sha2("line", 256).alias("digest"), sample.alias("samples"))


def scan_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of COCO files with their image and class; boxes need four numbers and a known image, a missing class fails."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,name:string>>, categories array<struct<id:long,name:string>>"
    c = spark.read.json(path, schema=schema, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    images = c.select("path", F.explode("images").alias("i")).select("path", F.col("i.id").alias("image_id"), "i.file_name")
    names = c.select("path", F.explode("categories").alias("k")).select("path", F.col("k.id").alias("category_id"), F.col("k.name").alias("category"))
    a = c.select("path", F.explode("annotations").alias("a")).select("path", "a.id", "a.image_id", "a.category_id", "a.bbox", "a.name").filter("size(bbox) = 4")
    out = a.join(images, ["path", "image_id"]).join(names, ["path", "category_id"], "left")  # ids hold within a file
    return out.withColumn("category", F.when(F.col("category").isNotNull(), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("no category "), F.col("category_id").cast("string"))).cast("string")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256, length`` of each file, by name."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name")
