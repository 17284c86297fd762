"""Suffix-array dedup: repeated byte strings by merging shard Burrows-Wheeler transforms.

The byte windows of every text are grouped by anchors (windows.py), and texts of runs with a repeated
anchor meet by the anchor's hash; an anchor that too much different text shares is split by longer ones.
There, strings are dealt to shards and read as symbols of STEP bytes, at every offset. Each shard has its
own suffix order and transform (the symbol before each suffix). The merge holds one array, the interleave:
which shard the next suffix comes from. A pass reads every shard's transform in the order that the
interleave gives, and deals its entries stably by the symbols read; after t passes the interleave is right
for t symbols, and a boundary that first appears in pass t has a common prefix of t - 1 symbols with what is
before it. No suffix is compared or sorted in the merge. Rows of the merged order between which every common
prefix is of 200 bytes or more are a repeated interval.

Nulls count as empty texts, a null doc_id is an ordinary one, repeated rows are documents of their own
(their strings start elsewhere), an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Rolling, distinct_texts, lists, materialize, read, spans_of, text_bytes, with_text_key
from tessera.llm.windows import bucketed, candidate_runs, covered, repeated_anchors, spans_by_text, split_hot

WINDOW = 200
#: Lengths of anchors; those after the first split groups of too much different text.
GRAMS = (24, 72, 136, 200)
#: Bytes of a symbol; a divisor of WINDOW.
STEP = 50
SHARDS = 4
#: Bytes of different texts in a group above which it is split.
HOT = 1 << 20


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """A stable order by radix passes over 16 bits."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]


def suffix_order(symbols: np.ndarray, before: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """All suffixes of one shard in order.

    symbols[i] starts at place i (0: none, a string's end), before[i] is how many bytes of the string are
    before it, and left[i] how many from there on. A suffix is the symbols at i, i + step, ...; ends come
    first, in order of place, so that no two suffixes are equal.
    """
    ends, order = np.flatnonzero(left < step), np.arange(len(symbols))
    for _ in range(int(left.max()) // step + 1):
        ahead = order[before[order] >= step] - step
        order = np.concatenate([ends, ahead[stable_order(symbols[ahead])]])
    return order


def merge_transforms(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes, right for so many symbols, and common prefixes.

    transforms[s]: for each suffix of shard s in order the symbol before it (0: none). prefixes[i]: how many
    symbols row i shares with row i - 1, at most passes.
    """
    sizes = [len(t) for t in transforms]
    interleave = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    block = np.zeros(len(interleave), np.int32)
    prefixes = np.full(len(interleave), passes, np.uint8)
    read = np.empty(len(interleave), transforms[0].dtype)
    for t in range(passes):
        for s, own in enumerate(transforms):
            read[interleave == s] = own
        order = stable_order(read)
        interleave, here, block = interleave[order], read[order], block[order]
        interleave[: np.searchsorted(here, 1)].sort()  # ends stand by shard, whatever was read before
        bound = here == 0  # every string's end is one of its own
        bound[1:] |= (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        bound[:1] = True
        prefixes[bound & (prefixes == passes)] = t
        block = np.cumsum(bound, dtype=np.int32)
    return interleave, prefixes


def repeated_positions(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, weights: np.ndarray, window: int = WINDOW, step: int = STEP, shards: int = SHARDS) -> np.ndarray:
    """Flags of the positions in strings data[starts[i]:stops[i]] (adjoining) whose window starts twice.

    weights[i] over 1: string i is there more than once.
    """
    flags = np.zeros(len(data), bool)
    length = (stops - starts).astype(np.int64)
    if not len(length) or length.max() < window:
        return flags
    # Every string has a place for each of its bytes and one for its end.
    string = np.repeat(np.arange(len(length)), length + 1)
    before = (np.arange(len(string)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)).astype(np.int32)
    left = (length[string] - before).astype(np.int32)
    whole = np.flatnonzero(left >= step)
    kinds, rank = np.unique(Rolling(data).grams(step)[whole - string[whole]], return_inverse=True)
    symbols = np.zeros(len(string), np.uint16 if len(kinds) < (1 << 16) - 1 else np.uint32)
    symbols[whole] = rank + 1
    del kinds, rank, whole
    # Strings are dealt to shards in order, by size; each shard's suffixes and transform.
    ends = np.cumsum(length + 1)
    cuts = np.unique(np.r_[0, ends[np.searchsorted(ends, ends[-1] * np.arange(1, shards) // shards)], ends[-1]])
    orders, transforms = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        order = suffix_order(symbols[a:b], before[a:b], left[a:b], step) + a
        ahead = np.maximum(order - step, 0)
        transforms.append(np.where(before[order] >= step, symbols[ahead], 0).astype(symbols.dtype))
        orders.append(order)
    interleave, prefixes = merge_transforms(transforms, window // step)
    place = np.empty(len(interleave), np.int64)
    for s, order in enumerate(orders):
        place[interleave == s] = order
    # Repeated intervals: rows whose common prefixes reach the window, of a weight of two or more.
    head = np.flatnonzero(prefixes < window // step)
    weight = np.add.reduceat(np.minimum(weights[string[place]], 2), head)
    twice = place[np.repeat(weight > 1, np.diff(np.r_[head, len(place)]))]
    twice = twice[left[twice] >= window]
    flags[twice - string[twice]] = True
    return flags


def repeated_runs(contents: DataFrame, window: int) -> DataFrame:
    """h, ch, lo, hi: the repeated windows of each content, from h, ch, content and weight."""

    def merge(batches):
        for batch in bucketed(batches, 1 << 16):
            h, weights = batch["h"].to_numpy(), batch["weight"].to_numpy()
            # A content alone under its anchor that is there twice is repeated as a whole; no merge can add to it.
            lone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True] & (weights > 1)
            batch, whole = batch.filter(pa.array(~lone)), batch.filter(pa.array(lone))
            if len(whole):
                one = np.ones(len(whole), np.int64)
                size = np.diff(text_bytes(whole["content"])[1])
                yield pa.record_batch([whole["h"], whole["ch"], lists(0 * one, one, pa.int32()), lists(size - window + 1, one, pa.int32())], names=["h", "ch", "lo", "hi"])
            if not len(batch):
                continue
            raw, offsets = text_bytes(batch["content"])
            data = raw[offsets[0] : offsets[-1]]
            starts, stops = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
            lo, hi = spans_of(repeated_positions(data, starts, stops, weights[~lone], window))
            if len(lo):
                own = np.searchsorted(stops, lo, "right")
                rows, count = np.unique(own, return_counts=True)
                yield pa.record_batch([batch["h"].take(pa.array(rows)), batch["ch"].take(pa.array(rows)), lists(lo - starts[own], count, pa.int32()), lists(hi - starts[own], count, pa.int32())], names=["h", "ch", "lo", "hi"])

    dealt = contents.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(merge, "h long, ch long, lo array<int>, hi array<int>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) of each document."""
    texts = lambda: distinct_texts(docs, F.count(F.lit(1)).alias("weight"))
    anchors = materialize(repeated_anchors(texts(), "bytes", window, GRAMS[0], True), "op2-anchors", free=True)
    found = materialize(candidate_runs(texts(), anchors, "bytes", window, GRAMS[0], "weight"), "op2-runs", free=True)
    found = split_hot(found, "bytes", window, GRAMS[1:], "weight", HOT, "op2-split")
    contents = found.groupBy("h", "ch").agg(F.first("content").alias("content"), F.sum(F.col("weight") * F.size("pos")).alias("weight"))
    runs = repeated_runs(contents, window)
    spans = materialize(spans_by_text(found.select("t1", "t2", "h", "ch", "pos").join(runs, ["h", "ch"])), "op2-spans", free=True)

    def apply(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            column = batch["spans"]
            values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows = []
            for i in range(len(batch)):
                text = raw[offsets[i] : offsets[i + 1]]
                own = values[at[i] : at[i + 1]]
                if len(own):
                    gone = covered(own, len(text), window)
                    lo, _ = spans_of(gone)
                    kept = text[~gone].tobytes()
                    rows.append((len(text), int(gone.sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                else:
                    kept = text.tobytes()
                    rows.append((len(text), 0, 0, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if rows else []
            if rows:
                yield pa.record_batch([batch["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    keyed = with_text_key(docs).join(spans, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
    return keyed.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_kept=False).drop("kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, len(h) // 2 AS n FROM d),
x AS (SELECT r, unnest(range(0, n - 199)) AS i, unnest(list_transform(range(0, n - 199), lambda i: md5(substr(h, 2 * i + 1, 400)))) AS k FROM n WHERE n >= 200),
t AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM x SEMI JOIN t USING (k)),
s AS (SELECT r, i, sum(CASE WHEN last IS NULL OR i > last + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM m),
p AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM s GROUP BY r, span),
e AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM p),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS done, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (lo - since) AS BIGINT)), '' ORDER BY lo) AS kept FROM e JOIN n USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(done, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN k USING (r)
"""
