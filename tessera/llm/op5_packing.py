"""Cost-balanced packing of token sequences.

Each task packs the documents it reads, in groups of some million tokens: no token leaves the task that
made it. A document's full pieces of 2048 tokens are sequences of their own; of what is left, longest
first by cost (linear plus quadratic, as attention costs), each goes to the sequence of least cost that
has room for it. A group opens just as many sequences as its tokens need, so where a piece has room
nowhere it is cut along the cheapest sequences: padding is under 2048 tokens a group.

Nulls count as empty texts (one token, id 1); a null doc_id is kept; repeated rows are packed like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read

LENGTH = 2048
#: Tokens that are packed together.
GROUP = 1 << 21
END_ID = 1
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 1024
#: The pre-tokenisation pattern of the vocabulary, and the same without look-ahead: equal on texts that
#: have no two white-space characters in a row, and twice as fast.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = PATTERN.replace(r"\s+(?!\S)|", "")


class Encoder:
    """Ids as the tokenizers library gives them, by a faster encoder of the same vocabulary."""

    def __init__(self, name: str, folder_of):
        import tiktoken
        from tokenizers import Tokenizer

        with open(folder_of(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.any = tiktoken.Encoding("any", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(folder_of(name + ".json"))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()) or r"(?!)")
        self.spaces = re.compile(r"\s\s")
        self.many_spaces = re.compile(r"\s{4096}")  # the fast encoder's pattern gives up on very long runs

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text, and END_ID after them."""
        if self.special.search(text) or self.many_spaces.search(text):  # the strings of special tokens have ids of their own
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.any if self.spaces.search(text) else self.plain).encode_to_numpy(text, disallowed_special=())
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1], out[-1] = ids, END_ID
        return out


def encoder(name: str) -> Encoder:
    """One encoder for each worker process."""
    held = sys.__dict__.setdefault("_tessera_encoders", {})
    if name not in held:
        import public_tokenizers

        held[name] = Encoder(name, public_tokenizers.path)
    return held[name]


def pack(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents with so many tokens."""
    pieces, rests, sequence = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - n % length, length):
            pieces.append((d, start, length, sequence, 0))
            sequence += 1
        if n % length:
            rests.append((n % length, d, n - n % length))
    rests.sort(key=lambda r: (-r[0], r[1]))  # cost grows with length
    many = -(-sum(r[0] for r in rests) // length)
    cost, room = np.zeros(many), np.full(many, length)
    for n, d, start in rests:
        while n:
            able = np.flatnonzero(room >= n)
            if not len(able):  # no sequence has room for all of it
                able = np.flatnonzero(room)
            s = int(able[np.argmin(cost[able])])
            k = min(n, int(room[s]))
            pieces.append((d, start, k, sequence + s, length - int(room[s])))
            room[s] -= k
            cost[s] += k + k * k / QUADRATIC
            start += k
            n -= k
    return pieces


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (uint32, little-endian)."""

    def run(batches):
        encode, sequence = encoder(vocabulary), TaskContext.get().partitionId() << 36
        held, ids, size = [], [], 0

        def flush():
            nonlocal sequence
            lengths = np.array([len(x) for x in held])
            pieces = pack(lengths)
            doc, start, length, own, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            views = [memoryview(held[d][a : a + n]).cast("B") for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [pa.concat_arrays(ids).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(v) for v in views], pa.int64()), pa.array(lengths[doc]), pa.array(own + sequence), pa.array(offset), pa.array([v.tobytes() for v in views] if with_ids else [None] * len(views), pa.binary())]
            sequence += int(own.max()) + 1
            return pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            texts, begin = batch["text"], 0
            for i in range(len(batch)):
                held.append(encode(texts[i].as_py()))
                size += len(held[-1])
                if size >= GROUP:
                    ids.append(batch["doc_id"].slice(begin, i + 1 - begin))
                    yield flush()
                    held, ids, size, begin = [], [], 0, i + 1
            if begin < len(batch):
                ids.append(batch["doc_id"].slice(begin))
        if held:
            yield flush()

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")
