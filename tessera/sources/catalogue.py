"""Catalogue files: a sequential binary format of ledgers with state deltas and transactions.

Files are read through Spark's binary reader, so any store Spark can read will do; a file is sequential and
is one task's work, many files are many tasks. Little-endian: a header of 88 bytes, then (deflated from
byte 88 on if the level is not 0) for each ledger 164 bytes, the state's items and the transactions', each
map ended by 0xFF.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = 0x4C544143
HEADER, HEADER_SIZE = "<IIIHHQ64s", 88
LEDGER, LEDGER_SIZE = "<I32s32s32s32sQIIQQ", 164
REMOVE, END = 254, 255
MOST = 64 << 20  # bytes of one item

LEDGERS = "file string, seq long, hash binary, tx_hash binary, account_hash binary, parent_hash binary, drops decimal(20,0), close_flags long, close_time_resolution long, close_time long, parent_close_time long"
ITEMS = "file string, seq long, map string, item_no long, type int, key binary, data binary"


def parse_header(data: bytes) -> dict:
    """The file's header; raises on a bad magic, version, range or size."""
    if len(data) < HEADER_SIZE:
        raise ValueError("the file is shorter than its header")
    magic, low, high, version, network, size, digest = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a catalogue file")
    if version & 0xFF != 1:
        raise ValueError(f"unknown version {version & 0xFF}")
    if low > high:
        raise ValueError("the ledger range is reversed")
    if size != len(data):
        raise ValueError(f"the header says {size} bytes, the file has {len(data)}")
    return {"min": low, "max": high, "level": version >> 8 & 15, "network": network, "digest": digest}


def body_of(data: bytes) -> bytes:
    return zlib.decompress(data[HEADER_SIZE :]) if parse_header(data)["level"] else data[HEADER_SIZE :]


def scan(data: bytes) -> Iterator[tuple[str, tuple]]:
    """("ledger", header fields) and ("state" or "tx", (seq, number, type, key, data)) in file order."""
    body, at = body_of(data), 0
    while at < len(body):
        if at + LEDGER_SIZE > len(body):
            raise ValueError("a ledger header is cut short")
        ledger = struct.unpack_from(LEDGER, body, at)
        at += LEDGER_SIZE
        yield "ledger", ledger
        for kind in ("state", "tx"):
            n = 0
            while True:
                if at >= len(body):
                    raise ValueError("a map has no end")
                item = body[at]
                at += 1
                if item == END:
                    break
                key, value = body[at : at + 32], None
                at += 32
                if item != REMOVE:
                    (size,) = struct.unpack_from("<I", body, at)
                    if size > MOST or at + 4 + size > len(body):
                        raise ValueError("an item is too long")
                    value, at = body[at + 4 : at + 4 + size], at + 4 + size
                if len(key) < 32:
                    raise ValueError("a key is cut short")
                yield kind, (ledger[0], n, item, key, value)
                n += 1


def build(ledgers: Iterable[tuple[tuple, list, list]], network: int = 0, level: int = 0) -> bytes:
    """A file of (ledger fields, state items, transaction items); items: (type, key, data or None)."""
    parts, low, high = [], None, 0
    for ledger, state, tx in ledgers:
        low, high = ledger[0] if low is None else low, ledger[0]
        parts.append(struct.pack(LEDGER, *ledger))
        for items in (state, tx):
            for kind, key, value in items:
                parts.append(bytes([kind]) + key + (b"" if kind == REMOVE else struct.pack("<I", len(value)) + value))
            parts.append(bytes([END]))
    body = b"".join(parts)
    body = zlib.compress(body, level) if level else body
    head = lambda digest: struct.pack(HEADER, MAGIC, low or 0, high, 1 | level << 8, network, HEADER_SIZE + len(body), digest)
    return head(hashlib.sha512(head(bytes(64)) + body).digest()) + body


def recompress(data: bytes, level: int) -> bytes:
    """The same ledgers at another level."""
    head, body = parse_header(data), body_of(data)
    body = zlib.compress(body, level) if level else body
    own = lambda digest: struct.pack(HEADER, MAGIC, head["min"], head["max"], 1 | level << 8, head["network"], HEADER_SIZE + len(body), digest)
    return own(hashlib.sha512(own(bytes(64)) + body).digest()) + body


def delta_items(removed: list[bytes], modified: list[tuple[bytes, bytes]], added: list[tuple[bytes, bytes]], kind: int = 4) -> list[tuple]:
    """Items of a delta in file order: removals, modifications, additions, each by ascending key."""
    return [(REMOVE, k, None) for k in sorted(removed)] + [(kind, k, v) for part in (modified, added) for k, v in sorted(part)]


# ---- on tables ------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    return ledgers_of(_files(spark, path))


def ledgers_of(files: DataFrame) -> DataFrame:
    """The ledgers of files (path, content)."""
    names = [c.split()[0] for c in LEDGERS.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *fields) for kind, fields in scan(bytes(content)) if kind == "ledger"]
                frame = pd.DataFrame(rows, columns=names, dtype=object)
                yield frame.assign(drops=frame["drops"].astype(str))  # unsigned 64 bits

    rows = files.mapInPandas(run, LEDGERS.replace("decimal(20,0)", "string"))
    return rows.withColumn("drops", F.col("drops").cast("decimal(20,0)"))


def read_items(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """All items; without data where only keys are asked for."""
    return items_of(_files(spark, path), with_data)


def items_of(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The items of files (path, content)."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for kind, fields in scan(bytes(content)):
                    if kind != "ledger":
                        seq, n, item, key, data = fields
                        rows.append((file, seq, kind, n, item, key, data if with_data else None))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])
                            rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return files.mapInPandas(run, ITEMS)


def write_files(delta: DataFrame, ledgers: DataFrame, span: int, level: int = 0, network: int = 0) -> DataFrame:
    """path, content: a file for each `span` versions of a history (seq, key, op, data: text) and its ledgers.

    ledgers: seq, hash, parent_hash (hex), close_time. A file is one task's work and holds its own versions' deltas.
    """
    file = lambda df: df.withColumn("file", F.floor(F.col("seq") / span).cast("int"))

    def run(key, heads, rows):
        parts = []
        by_seq = dict(tuple(rows.groupby("seq")))
        for h in heads.sort_values("seq").itertuples():
            own = by_seq.get(h.seq)
            items = [] if own is None else [(int(op), bytes.fromhex(k), None if op == REMOVE else v.encode()) for k, op, v in sorted(zip(own["key"], own["op"], own["data"], strict=True))]
            parent = bytes.fromhex(h.parent_hash) if isinstance(h.parent_hash, str) else bytes(32)
            parts.append(((int(h.seq), bytes.fromhex(h.hash), bytes(32), bytes(32), parent, 0, 0, 10, int(h.close_time), 0), items, []))
        return pd.DataFrame({"path": [f"{key[0]}.catalogue"], "content": [build(parts, network, level)]})

    return file(ledgers).groupBy("file").cogroup(file(delta).groupBy("file")).applyInPandas(run, "path string, content binary")


def as_delta(items: DataFrame) -> DataFrame:
    """State items as a history (seq, key, op, data) with keys in hex."""
    return items.where("map = 'state'").select(F.col("seq").cast("int").alias("seq"), F.lower(F.hex("key")).alias("key"), F.col("type").alias("op"), "data")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return hashes_of(_files(spark, path))


def hashes_of(files: DataFrame) -> DataFrame:
    """path, stored, computed, valid: SHA-512 of each file (path, content) with the hash field zeroed."""
    zeroed = F.concat(F.substring("content", 1, 24), F.lit(bytes(64)), F.expr("substring(content, 89)"))
    both = files.select("path", F.lower(F.hex(F.substring("content", 25, 64))).alias("stored"), F.sha2(zeroed, 512).alias("computed"))
    return both.withColumn("valid", F.col("stored") == F.col("computed"))


def validate(spark: SparkSession, path: str) -> DataFrame:
    """path, ledgers, items, problem (null if none) of each file."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                ledgers = items = 0
                problem = None
                try:
                    for kind, _ in scan(bytes(content)):
                        ledgers += kind == "ledger"
                        items += kind != "ledger"
                except (ValueError, zlib.error, struct.error) as e:
                    problem = str(e)
                rows.append((file, ledgers, items, problem))
            yield pd.DataFrame(rows, columns=["path", "ledgers", "items", "problem"])

    return _files(spark, path).mapInPandas(run, "path string, ledgers long, items long, problem string")


# ---- hash-table data files ------------------------------------------------------------------------

DAT_HEADER = 92


def scan_dat(data: bytes, key_size: int) -> Iterator[tuple]:
    """record_no, offset, size, key, value of each record (spills: size 0); stops at a partial tail."""
    at, n = DAT_HEADER, 0
    while at + 6 <= len(data):
        size = int.from_bytes(data[at : at + 6], "big")
        if size == 0:
            if at + 8 > len(data):
                return
            end = at + 8 + int.from_bytes(data[at + 6 : at + 8], "big")
            if end > len(data):
                return
            yield n, at, 0, None, data[at + 8 : end]
        else:
            end = at + 6 + key_size + size
            if end > len(data):
                return
            yield n, at, size, data[at + 6 : at + 6 + key_size], data[at + 6 + key_size : end]
        at, n = end, n + 1


def read_dat(spark: SparkSession, path: str, key_size: int = 32) -> DataFrame:
    names = ["record_no", "offset", "size", "key", "value"]

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(scan_dat(bytes(content), key_size)), columns=names)

    return _files(spark, path).mapInPandas(run, "record_no long, offset long, size long, key binary, value binary")
