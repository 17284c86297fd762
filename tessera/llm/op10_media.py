"""Media columns: texts as lossless WebP images, read back to pixel arrays and features.

A payload is a text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576. Each byte is a grey
pixel; 576 pixels make a row (more in payloads of over 9 MB). The file holds a palette of the bytes that
occur, their indices (several in a pixel where there are few), and what repeats as back-references; so every
query decodes prefix codes, back-references and palettes. A payload of over 264 MB goes into several images,
one file after another. Features come from the pixels that were read back.

Null and empty texts give one row of bytes 255. Equal texts give equal values. A null doc_id is kept;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, text_bytes
from tessera.llm.webp import MOST, decode, encode_indexed

UNIT = 576
FILL = 255


def to_media(payload: np.ndarray, most: int = MOST) -> bytes:
    """The WebP file (files one after another if it is long) that holds a payload (a multiple of UNIT bytes), row by row."""
    across_most = MOST // UNIT
    if len(payload) > most * across_most * UNIT:
        each = most * across_most * UNIT
        return b"".join(to_media(payload[a : a + each], most) for a in range(0, len(payload), each))
    units = len(payload) // UNIT
    across = -(-units // most)
    rows = -(-units // across)
    full = rows * across * UNIT
    pixels = payload if full == len(payload) else np.r_[payload, np.full(full - len(payload), FILL, np.uint8)]
    used = np.bincount(pixels, minlength=256) > 0
    place = (np.cumsum(used) - 1).astype(np.uint8)
    grey = np.flatnonzero(used).astype(np.uint32)
    return encode_indexed(place[pixels].reshape(rows, across * UNIT), np.uint32(0xFF000000) | grey * np.uint32(0x010101))


def from_media(media: bytes, n_bytes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The payload of n_bytes in a file or files, and the images' pixels."""
    images, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        images.append(decode(media[at : at + size]))
        at += size
    grey = [np.ascontiguousarray(x[..., 1]).ravel() for x in images]
    return (grey[0] if len(grey) == 1 else np.concatenate(grey))[:n_bytes], images


def feature(images: list[np.ndarray]) -> str:
    """Size, mean and deviation of each colour (in thousandths), and a histogram of the green in 8 steps."""
    count = np.stack([sum(np.bincount(x[..., k].ravel(), minlength=256) for x in images) for k in range(3)])
    n, values = int(count[0].sum()), np.arange(256)
    mean = count @ values / n
    deviation = np.sqrt(np.maximum(count @ values**2 / n - mean * mean, 0))
    steps = count[1].reshape(8, 32).sum(1)
    sizes = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in images)
    return f"{sizes} mean " + ",".join(str(round(1000 * x)) for x in mean) + " sd " + ",".join(str(round(1000 * x)) for x in deviation) + " green " + ",".join(map(str, steps))


def media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and media (the file)."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def convert(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a
                payload = np.full(max(1, -(-n // UNIT)) * UNIT, FILL, np.uint8)
                payload[:n] = raw[a:b]
                file = to_media(payload)
                back, images = from_media(file, len(payload))
                back = back.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(images), file if with_media else None))
            if rows:
                yield pa.record_batch([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(convert, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(read(spark, sf_dir, "documents"), with_media=False).drop("media")
