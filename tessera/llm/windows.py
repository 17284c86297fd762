"""Finding equal windows across a corpus without shuffling every window.

The windows (200 bytes, 13 words) of a text are grouped into runs that share an anchor: the gram of least
hash in the window. Equal windows have equal anchors at equal places, so only runs whose anchor occurs
twice can hold a repeated window, and equal windows always meet under their anchor's hash. Three
exchanges, each in proportion to the corpus: the anchors' hashes, the anchors by hash, and the text of
runs with a repeated anchor, once for each different content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SEGMENT, Rolling, cut, lists, materialize, mix, powers, segments, text_bytes, window_runs

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def byte_pieces(column: pa.Array, window: int, gram: int):
    """Runs of byte windows: rows, first window, windows, anchor, content's hash, data and its byte range."""
    data, offsets = text_bytes(column)
    for rows, starts, stops, firsts in segments(offsets, window):
        base = int(starts[0])
        part = data[base : int(stops[-1])]
        if not len(part):
            continue
        roll = Rolling(part)
        unit, at, size, anchor = window_runs(roll.grams(gram), starts - base, stops - base, gram, window)
        if len(unit):
            yield rows[unit], at - (starts - base)[unit] + firsts[unit], size, anchor, roll.of(at, at + size + window - 1), part, at, at + size + window - 1


def words_in(data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Byte ranges of the words in adjoining texts data[starts[i]:stops[i]], and each text's count."""
    base, end = int(starts[0]), int(stops[-1])
    solid = ~_SPACE[data[base:end]]
    bound = np.zeros(end - base + 1, bool)
    bound[starts - base] = True
    first = np.flatnonzero(solid & (bound[:-1] | ~np.r_[False, solid[:-1]]))
    bound[-1] = True
    last = np.flatnonzero(solid & (bound[1:] | ~np.r_[solid[1:], False])) + 1
    count = np.searchsorted(first, stops - base) - np.searchsorted(first, starts - base)
    return first, last, count


def word_pieces(column: pa.Array, reach: int, limit: int = 1 << 18):
    """The words of a column in pieces of whole texts or, for a long text, of overlapping runs of words.

    Yields rows, starts, stops, firsts (all in words), the words' hashes, data and their byte ranges.
    """
    data, offsets = text_bytes(column)
    size = SEGMENT
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] <= size:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            a, b = int(offsets[i]), int(offsets[j])
            if b > a:
                part = data[a:b]
                first, last, count = words_in(part, offsets[i:j] - a, offsets[i + 1 : j + 1] - a)
                ends = np.cumsum(count)
                yield np.arange(i, j), ends - count, ends, np.zeros(j - i, np.int64), Rolling(part).of(first, last), part, first, last
            i = j
            continue
        found, a, b = [], int(offsets[i]), int(offsets[i + 1])
        text = data[a:b]
        at = 0
        while at < len(text):
            stop = min(at + size, len(text))
            while stop < len(text) and not _SPACE[text[stop]]:  # a segment ends before a space
                ahead = np.flatnonzero(_SPACE[text[stop : stop + size]])
                stop = stop + int(ahead[0]) if len(ahead) else min(stop + size, len(text))
            first, last, _ = words_in(text[at:stop], np.array([0]), np.array([stop - at]))
            found.append((first + at, last + at, Rolling(text[at:stop]).of(first, last)))
            at = stop
        first, last, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        for s in range(0, max(len(first) - reach + 1, 1), limit):
            e = min(s + limit + reach - 1, len(first))
            yield np.array([i]), np.array([0]), np.array([e - s]), np.array([s]), hashes[s:e], text, first[s:e], last[s:e]
        i += 1


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive hashes."""
    _, pw, _ = powers(k + 1)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += mix(hashes[i : i + n]) * pw[i]
    return mix(out)


def word_runs(column: pa.Array, window: int, gram: int):
    """As byte_pieces, for windows of words; contents are compared as sequences of words."""
    for rows, starts, stops, firsts, hashes, data, first, last in word_pieces(column, window):
        if not len(hashes):
            continue
        unit, at, size, anchor = window_runs(gram_hashes(hashes, gram), starts, stops, gram, window)
        if len(unit):
            n = len(hashes)
            _, pw, ipw = powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(hashes) * pw[:n], out=sums[1:])
            end = at + size + window - 1
            content = mix((sums[end] - sums[at]) * ipw[at] ^ (end - at).astype(np.uint64))
            yield rows[unit], at - starts[unit] + firsts[unit], size, anchor, content, data, first[at], last[end - 1]


def runs(kind: str, column: pa.Array, window: int, gram: int):
    return byte_pieces(column, window, gram) if kind == "bytes" else word_runs(column, window, gram)


def _heads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each group starts in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def repeated_anchors(texts: DataFrame, kind: str, window: int, gram: int, within: bool) -> DataFrame:
    """t1, t2, hs: the anchors of each text that occur elsewhere, or twice in it if within.

    texts may hold exact copies if not within: an anchor counts if it is in two different texts.
    """

    def scan(batches):
        for batch in batches:
            weight = batch["weight"].to_numpy(zero_copy_only=False) if within else None
            for rows, _, _, anchor, *_ in runs(kind, batch["text"], window, gram):
                order, head = _heads(rows, anchor)
                row, value = rows[order][head], anchor[order][head]
                if within:  # twice in one text, or a text that is there twice
                    more = (np.diff(np.r_[head, len(order)]) > 1) | (weight[row] > 1)
                    row, value = np.repeat(row, 1 + more), np.repeat(value, 1 + more)
                own, count = np.unique(row, return_counts=True)
                own = pa.array(own)
                yield pa.record_batch([batch["t1"].take(own), batch["t2"].take(own), lists(value.view(np.int64), count, pa.int64())], names=["t1", "t2", "hs"])

    each = texts.mapInArrow(scan, "t1 long, t2 long, hs array<long>").select("t1", "t2", F.explode("hs").alias("h"))
    if within:
        twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    else:
        twice = each.groupBy("h").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).where("low <> high").select("h")
    return each.join(twice, "h", "left_semi").groupBy("t1", "t2").agg(F.collect_set("h").alias("hs"))


def candidate_runs(texts: DataFrame, anchors: DataFrame, kind: str, window: int, gram: int, value: str) -> DataFrame:
    """t1, t2, value, h, ch, n, pos, content: a row for each text and different run with a repeated anchor."""

    def scan(batches):
        for batch in batches:
            wanted, many = batch["hs"].flatten().to_numpy().view(np.uint64), np.diff(batch["hs"].offsets.to_numpy())
            wanted = np.unique(mix(wanted ^ mix(np.repeat(np.arange(len(many)), many).astype(np.uint64))))
            for rows, at, size, anchor, content, data, start, stop in runs(kind, batch["text"], window, gram):
                key = mix(anchor ^ mix(rows.astype(np.uint64)))
                near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = np.flatnonzero(wanted[near] == key)
                if not len(hit):
                    continue
                order, head = _heads(rows[hit], anchor[hit], content[hit])
                hit = hit[order]
                one, count = hit[head], np.diff(np.r_[head, len(hit)])
                for a in range(0, len(one), 4096):
                    o, c = one[a : a + 4096], count[a : a + 4096]
                    own = pa.array(rows[o])
                    pos = at[hit[head[a] : head[a] + c.sum()]]
                    yield pa.record_batch(
                        [batch["t1"].take(own), batch["t2"].take(own), batch[value].take(own), pa.array(anchor[o].view(np.int64)), pa.array(content[o].view(np.int64)), pa.array(size[o], pa.int32()), lists(pos, c, pa.int32()), cut(data, start[o], stop[o])],
                        names=["t1", "t2", value, "h", "ch", "n", "pos", "content"],
                    )

    joined = texts.join(anchors, ["t1", "t2"])
    return joined.mapInArrow(scan, f"t1 long, t2 long, {value} long, h long, ch long, n int, pos array<int>, content binary")


def split_hot(found: DataFrame, kind: str, window: int, grams: tuple, value: str, most: int, tag: str) -> DataFrame:
    """The rows of candidate_runs with no group (h) of over `most` items of different contents.

    Runs of a larger group are cut by a longer anchor within the group, again and again: equal windows still
    meet, as they choose the same one. The last of grams is the window itself, whose groups hold one content.
    """

    def cut_runs(gram):
        def run(batches):
            for batch in batches:
                h, pos = batch["h"].to_numpy().view(np.uint64), batch["pos"]
                values, ends = pos.values.to_numpy(), pos.offsets.to_numpy()
                for rows, at, size, anchor, content, data, start, stop in runs(kind, batch["content"], window, gram):
                    for a in range(0, len(rows), 4096):
                        part = slice(a, a + 4096)
                        own, count = rows[part], np.diff(ends)[rows[part]]
                        pick = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[own], count)
                        key = mix(anchor[part] ^ mix(h[own] + np.uint64(gram)))
                        take = pa.array(own)
                        yield pa.record_batch(
                            [batch["t1"].take(take), batch["t2"].take(take), batch[value].take(take), pa.array(key.view(np.int64)), pa.array(content[part].view(np.int64)), pa.array(size[part], pa.int32()), lists(values[pick] + np.repeat(at[part], count), count, pa.int32()), cut(data, start[part], stop[part])],
                            names=["t1", "t2", value, "h", "ch", "n", "pos", "content"],
                        )

        return run

    size, done = F.sum(F.col("n").cast("long") + (window - 1)), None
    for gram in grams:
        many = found.groupBy("h").agg(size.alias("items")).where(f"items > {most}").select("h")  # copies included
        kinds = found.select("h", "ch", "n").join(many, "h", "left_semi").groupBy("h", "ch").agg(F.first("n").alias("n"))
        hot = materialize(kinds.groupBy("h").agg(size.alias("items")).where(f"items > {most}").select("h"), f"{tag}-hot")
        if hot.isEmpty():
            break
        rest = found.join(hot, "h", "left_anti").select("t1", "t2", value, "h", "ch", "n", "pos", "content")
        done = rest if done is None else done.unionByName(rest)
        finer = found.join(hot, "h", "left_semi").select(*rest.columns).mapInArrow(cut_runs(gram), rest.schema)
        found = materialize(finer, tag, free=True)
    return found if done is None else done.unionByName(found)


def bucketed(batches, least: int):
    """Joins rows that are sorted by h into tables of about least bytes of content that cut no h in two."""
    held, size = [], 0
    for batch in batches:
        h, at = batch["h"].to_numpy(), 0
        ends = np.cumsum(np.diff(text_bytes(batch["content"])[1]))
        while at < len(h):
            done = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, done + max(least - size, 0)))  # the row with which there is enough
            stop = min(max(stop, at), len(h) - 1)
            if size >= least and held[-1]["h"][-1].as_py() != h[at]:
                yield joined(held)
                held, size = [], 0
                continue
            stop = int(np.searchsorted(h, h[stop], "right"))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - done
            at = stop
            if at < len(h) and size >= least:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def spans_by_text(found: DataFrame) -> DataFrame:
    """t1, t2, spans: first window << 32 | windows, from rows with pos, lo and hi."""
    shifted = F.expr("flatten(transform(pos, p -> transform(arrays_zip(lo, hi), x -> (cast(p + x.lo as bigint) * 4294967296L) + (x.hi - x.lo))))")
    return found.select("t1", "t2", shifted.alias("s")).groupBy("t1", "t2").agg(F.flatten(F.collect_list("s")).alias("spans"))


def covered(spans: np.ndarray, length: int, window: int) -> np.ndarray:
    """Flags of the items that lie in a window of spans."""
    change = np.zeros(length + 1, np.int64)
    first, many = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(change, first, 1)
    np.add.at(change, first + many + window - 1, -1)
    return np.cumsum(change[:-1]) > 0
