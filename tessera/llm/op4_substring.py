"""Substring dedup by relative Lempel-Ziv factors.

Documents meet by the anchors of their windows of 13 words (windows.py); an anchor that too many different
contents share is split by longer ones. What meets under one anchor is a reference block: the different
contents there, indexed by window, each with the smallest doc_id that has it. Every content is parsed
greedily against the contents of smaller doc_ids: where the window at the cursor is in the block, the factor
goes on word by word as long as the source does, and the cursor moves behind it; else it moves a word on. A
factor of 13 words or more is a duplicate span. The windows across its end lie in no factor and are looked up
one by one. Hashes only propose: words are compared.

Nulls count as empty texts. A document with a null doc_id is neither smaller nor larger than another: it
keeps all words and removes none. Rows with equal doc_id do not remove from each other. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Rolling, distinct_texts, lists, materialize, read, text_bytes, with_text_key
from tessera.llm.windows import bucketed, candidate_runs, covered, gram_hashes, repeated_anchors, spans_by_text, split_hot, words_in

WINDOW = 13
#: Lengths of anchors; those after the first split groups of too many different contents.
GRAMS = (5, 9, 13)
#: Words of different contents in a group above which it is split.
HOT = 1 << 17


class Block:
    """The windows of the contents that met, by hash, with the place that the smallest doc_id has for each.

    words: the words' hashes; first and last: their byte ranges in data; at and unit: each window's first word
    and content; owner: each content's smallest doc_id; stops: the word behind each content.
    """

    def __init__(self, data, first, last, words, at, unit, owner, stops, window):
        self.data, self.first, self.last, self.window = data, first, last, window
        self.at, self.unit, self.owner, self.stops = at, unit, owner, stops
        self.key = gram_hashes(words, window)[at] if len(at) else np.zeros(0, np.uint64)
        self.order = np.lexsort((owner[unit], self.key))
        ranked = self.key[self.order]
        self.head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.keys = ranked[self.head]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] are equal."""
        size = self.last[a] - self.first[a]
        equal = size == self.last[b] - self.first[b]
        i = np.flatnonzero(equal)
        if len(i):
            n = size[i]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = self.data[np.repeat(self.first[a[i]], n) + step] != self.data[np.repeat(self.first[b[i]], n) + step]
            equal[i] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return equal

    def find(self, w: np.ndarray) -> np.ndarray:
        """For each window the one with its words that the smallest doc_id has, if smaller than its own; else -1."""
        place = self.head[np.searchsorted(self.keys, self.key[w])]
        source = self.order[place]
        source = np.where(self.owner[self.unit[source]] < self.owner[self.unit[w]], source, -1)
        hit = np.flatnonzero(source >= 0)
        reach = np.arange(self.window)
        a, b = self.at[w[hit]][:, None] + reach, self.at[source[hit]][:, None] + reach
        for i in hit[~self.same(a.ravel(), b.ravel()).reshape(-1, self.window).all(1)] if len(hit) else ():
            source[i] = self._exactly(int(w[i]), int(place[i]))  # other words have this hash as well
        return source

    def _exactly(self, w: int, place: int) -> int:
        reach = np.arange(self.window)
        while place < len(self.order):
            source = int(self.order[place])
            if self.key[source] != self.key[w] or self.owner[self.unit[source]] >= self.owner[self.unit[w]]:
                break
            if self.same(self.at[w] + reach, self.at[source] + reach).all():
                return source
            place += 1
        return -1


def factors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The first window and the words of every factor of a window or more, of all contents."""
    begin = np.flatnonzero(np.r_[True, block.unit[1:] != block.unit[:-1]]) if len(block.unit) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(block.unit)]
    cursor, starts, lengths = begin.copy(), [], []
    while True:
        live = np.flatnonzero(cursor < end)
        if not len(live):
            break
        w = cursor[live]
        source = block.find(w)
        hit = source >= 0
        cursor[live[~hit]] += 1  # a factor of less than a window
        live, w, source = live[hit], w[hit], source[hit]
        size = np.full(len(w), block.window)
        here, there = block.stops[block.unit[w]], block.stops[block.unit[source]]
        on = np.arange(len(w))
        while len(on):
            a, b = block.at[w[on]] + size[on], block.at[source[on]] + size[on]
            inside = (a < here[on]) & (b < there[on])
            on, a, b = on[inside], a[inside], b[inside]
            on = on[block.same(a, b)] if len(on) else on
            size[on] += 1
        starts.append(w)
        lengths.append(size)
        cursor[live] = w + size
    return (np.concatenate(starts), np.concatenate(lengths)) if starts else (np.zeros(0, np.int64),) * 2


def known_windows(block: Block) -> np.ndarray:
    """Flags of the windows that a smaller doc_id has: those inside factors, and those found across their ends."""
    flags = np.zeros(len(block.at), bool)
    start, size = factors(block)
    if not len(start):
        return flags
    inside = size - block.window + 1
    step = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    flags[np.repeat(start, inside) + step] = True
    # The windows that begin in a factor and end behind it.
    across = (start + inside)[:, None] + np.arange(block.window - 1)
    across = across[(across < len(flags)) & (block.unit[np.minimum(across, len(flags) - 1)] == block.unit[start][:, None])]
    across = np.unique(across)
    flags[across[block.find(across) >= 0]] = True
    return flags


def duplicate_runs(contents: DataFrame, window: int) -> DataFrame:
    """h, ch, owner, lo, hi: what smaller doc_ids have of each content (h, ch, content, owner)."""

    def parse(batches):
        for batch in bucketed(batches, 1 << 18):
            h = batch["h"].to_numpy()
            # A content alone under its anchor has no block to be parsed against.
            lone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True]
            batch, whole = batch.filter(pa.array(~lone)), batch.filter(pa.array(lone))
            if len(whole):
                none = np.zeros(len(whole), np.int64)
                yield pa.record_batch([whole["h"], whole["ch"], whole["owner"], lists(none[:0], none, pa.int32()), lists(none[:0], none, pa.int32())], names=["h", "ch", "owner", "lo", "hi"])
            if not len(batch):
                continue
            raw, offsets = text_bytes(batch["content"])
            data = raw[offsets[0] : offsets[-1]]
            first, last, many = words_in(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            stops = np.cumsum(many)
            count = np.maximum(many - window + 1, 0)
            unit = np.repeat(np.arange(len(many)), count)
            at = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
            block = Block(data, first, last, Rolling(data).of(first, last), at + np.repeat(stops - many, count), unit, batch["owner"].to_numpy(), stops, window)
            found = known_windows(block)
            open_ = found & np.r_[True, ~found[:-1] | (unit[1:] != unit[:-1])]
            shut = found & np.r_[~found[1:] | (unit[1:] != unit[:-1]), True]
            first, last = np.flatnonzero(open_), np.flatnonzero(shut)
            count = np.bincount(unit[first], minlength=len(batch))
            yield pa.record_batch([batch["h"], batch["ch"], batch["owner"], lists(at[first], count, pa.int32()), lists(at[last] + 1, count, pa.int32())], names=["h", "ch", "owner", "lo", "hi"])

    dealt = contents.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(parse, "h long, ch long, owner long, lo array<int>, hi array<int>")


def remove_known(docs: DataFrame, window: int = WINDOW, with_kept: bool = True, others: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, if asked for kept (words joined by a space), and the named others of docs."""
    texts = lambda: distinct_texts(docs, F.min("doc_id").alias("owner")).where("owner is not null")
    # Anchors are hashed where the documents lie; only the second pass brings equal texts together.
    every = with_text_key(docs.where("doc_id is not null")).select("t1", "t2", "text")
    anchors = materialize(repeated_anchors(every, "words", window, GRAMS[0], False), "op4-anchors", free=True)
    found = materialize(candidate_runs(texts(), anchors, "words", window, GRAMS[0], "owner"), "op4-runs", free=True)
    found = split_hot(found, "words", window, GRAMS[1:], "owner", HOT, "op4-split")
    contents = found.groupBy("h", "ch").agg(F.first("content").alias("content"), F.min("owner").alias("owner"))
    known = duplicate_runs(contents, window).withColumnRenamed("owner", "least")
    # A content that an earlier document has is known whole; else what its windows' own search found.
    whole = F.col("owner") > F.col("least")
    joined = found.select("t1", "t2", "h", "ch", "pos", "n", "owner").join(known, ["h", "ch"])
    joined = joined.withColumn("lo", F.when(whole, F.array(F.lit(0))).otherwise(F.col("lo"))).withColumn("hi", F.when(whole, F.array("n")).otherwise(F.col("hi")))
    owners = with_text_key(docs).groupBy("t1", "t2").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    spans = spans_by_text(joined.where("size(lo) > 0"))
    spans = materialize(spans.join(owners, ["t1", "t2"], "full_outer").select("t1", "t2", "owner", "spans"), "op4-spans", free=True)
    rest = [o for o in others if o != "text"]
    keyed = with_text_key(docs, *rest).join(spans, ["t1", "t2"], "left")
    keyed = keyed.select("doc_id", "text", *rest, (F.col("owner").isNotNull() & (F.col("doc_id") > F.col("owner"))).alias("later"), F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"))
    keyed = keyed.select("doc_id", "text", *rest, F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return keyed.mapInArrow(_applier(window, with_kept, others), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + kinds)


def _applier(window: int, with_kept: bool, others: tuple):
    def apply(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            values, at = batch["spans"].values.to_numpy(zero_copy_only=False), batch["spans"].offsets.to_numpy()
            later = batch["later"].to_numpy(zero_copy_only=False)
            rows = []
            for i in range(len(batch)):
                words = raw[offsets[i] : offsets[i + 1]].tobytes().split()  # splits at the six ASCII white-space bytes
                n, own = len(words), values[at[i] : at[i + 1]]
                if later[i] and n >= window:  # an exact copy of an earlier document
                    words = []
                elif len(own):
                    words = [words[j] for j in np.flatnonzero(~covered(own, n, window))]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.record_batch([batch["doc_id"], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary()).cast(pa.string()), *(batch[o] for o in others)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *others])

    return apply


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_known(read(spark, sf_dir, "documents"), with_kept=False).drop("kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS k FROM d WHERE len(w) >= 13),
f AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (k) WHERE doc_id > least),
v AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS t FROM v ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
