"""MinHash near-dedup with ProbMinHash signatures.

Texts become sets of weighted five-word shingles; a shingle's weight is how many bytes its words have (255 at
most), so that it is the same in every text. Each shingle is a Poisson process of arrivals with its weight as
rate; an arrival falls on a component of the signature that its shingle has not hit before, and the first
arrival on a component gives it its value. A process stops as soon as it is later than every component's
first arrival. Components of two texts are equal with the probability Jaccard of their weighted sets, which
for weights that belong to shingles is the weight of the common shingles over that of all. Bands of
components propose pairs; exactly that measure, 0.8 or more, decides. How often a text repeats a shingle does
not count: copies that repeat a line a different number of times are still copies.

Exact copies are one text from the start. No bucket's pairs are listed. First every bucket's members meet
one centre (the member with most company in all its buckets), and the links found make components. Only
buckets whose other members are still of several components are looked at again, without the centre, in blocks
of bounded size: a task computes the weights of all common sets by a product of membership matrices, and sends
on one link for each member that it connects. So every pair of a bucket is compared or known to be connected,
and no link is lost. Keys that hold a large share of the rows (buckets, centres, classes, copies) are dealt to
many tasks.

Bands are exchanged with their texts' keys only if their bucket has company. Others are left out by a table of
bits that all tasks hold (8 MB at most); an exact join follows, so a bit that is set by chance costs an exchanged
row and changes nothing.

Nulls count as empty texts; texts without words are linked to nothing, not to each other. Texts of one to
four words have one shingle of all words. A class is named by its smallest doc_id (null if it has none).
Repeated rows fall in one class. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FEW, HOT, WORD, distinct_texts, hot_keys, lists, materialize, mix, read, spread_join, with_text_key
from tessera.llm.windows import gram_hashes, word_pieces

SHINGLE = 5
#: At a similarity of 0.8 a pair shares a band with a probability of 0.9993, at 0.3 with 0.0026.
BANDS, ROWS = 40, 8
COMPONENTS = 331  # a prime of at least BANDS * ROWS
THRESHOLD = 0.8
#: Members of a bucket that meet in one task (twice as many where two blocks meet).
BLOCK = 1536
#: Bits of a sieve at most: 8 MB, of which 7 million keys set a tenth.
SIEVE = 1 << 26


#: The low bits of an element hold its weight, the others its shingle's hash.
WEIGHT = np.uint64(255)


def weights_of(elements: np.ndarray) -> np.ndarray:
    return (elements & WEIGHT).astype(np.int64)


def shingles(column: pa.Array, k: int = SHINGLE):
    """The different weighted shingles of the texts of a column: rows, index into rows and elements (sorted by row)."""
    held: list = []

    def weighted(hashes, sizes):
        return (hashes & ~WEIGHT) | np.clip(sizes, 1, 255).astype(np.uint64)

    def whole_text():
        elements = np.concatenate([h for _, h in held])
        return _different(np.array([held[0][0]]), np.zeros(len(elements), np.int64), elements)

    for rows, starts, stops, firsts, hashes, _, first, last in word_pieces(column, k):
        if held and held[0][0] != rows[0]:
            yield whole_text()
            held = []
        size = np.concatenate([[0], np.cumsum(last - first)])
        words = stops - starts
        grams = weighted(gram_hashes(hashes, k), size[k:] - size[:-k]) if len(hashes) >= k else np.zeros(0, np.uint64)
        if len(rows) == 1 and (firsts[0] or words[0] >= 1 << 18):  # a part of a long text
            held.append((int(rows[0]), grams))
            continue
        count = np.maximum(words - k + 1, 0)
        unit = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        short = np.flatnonzero((words > 0) & (words < k))
        whole = np.array([gram_hashes(hashes[starts[i] : stops[i]], int(words[i]))[0] for i in short], np.uint64)
        yield _different(rows, np.r_[unit, short], np.r_[grams[at], weighted(whole, size[stops[short]] - size[starts[short]])])
    if held:
        yield whole_text()


def _different(rows: np.ndarray, unit: np.ndarray, elements: np.ndarray):
    order = np.lexsort((elements, unit))
    unit, elements = unit[order], elements[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (elements[1:] != elements[:-1])
    return rows, unit[new], elements[new]


def signatures(unit: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """n signatures of m components: the elements whose arrival on each component is the first."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    base = unit * m
    at = np.zeros(len(elements))
    place = (mix(elements ^ np.uint64(0x51)) % np.uint64(m)).astype(np.int64)
    step = (mix(elements ^ np.uint64(0xA7)) % np.uint64(m - 1)).astype(np.int64) + 1  # m is prime: all components in turn
    unit, elements, rate = unit.copy(), elements.copy(), weights / m
    for i in range(m):
        if not len(elements):
            break
        u = (mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64)
        at = at - np.log((u + 1) * 2.0**-53) / (rate * (m - i))  # until it hits a component that is new to it
        slot = base + place
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        winner[slot[won]] = elements[won]
        late = first.reshape(n, m).max(1)
        go = at < late[unit]  # later arrivals of the others cannot be first anywhere
        if not go.all():
            unit, elements, rate, at, place, step, base = (x[go] for x in (unit, elements, rate, at, place, step, base))
        place = (place + step) % m
    return winner.reshape(n, m)


def banded(texts: DataFrame) -> DataFrame:
    """t1, t2, n (the weight of its shingles) and bands (a hash for each band) of texts that have words."""

    def run(batches):
        for batch in batches:
            for rows, unit, elements in shingles(batch["text"]):
                weights = weights_of(elements)
                many = np.bincount(unit, weights, len(rows)).astype(np.int64)
                some = np.flatnonzero(many)
                if not len(some):
                    continue
                back = np.cumsum(many > 0) - 1
                own = signatures(back[unit], elements, weights.astype(float), len(some))[:, : BANDS * ROWS].reshape(-1, ROWS)
                bands = gram_hashes_rows(own).reshape(len(some), BANDS) ^ mix(np.arange(BANDS, dtype=np.uint64))
                take = pa.array(rows[some])
                yield pa.record_batch([batch["t1"].take(take), batch["t2"].take(take), pa.array(many[some]), lists(bands.ravel().view(np.int64), np.full(len(some), BANDS), pa.int64())], names=["t1", "t2", "n", "bands"])

    return texts.mapInArrow(run, "t1 long, t2 long, n long, bands array<long>")


def sieve(keys: DataFrame) -> np.ndarray:
    """A bit set for each key (one column of hashes) by its low end, among 16 bits or more for each; SIEVE at most."""
    keys = keys.toDF("k")
    bits = min(SIEVE, 1 << (16 * keys.count() + 64).bit_length())
    at = F.col("k").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 AS int))")).alias("w")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["at"].to_numpy()] = words["w"].to_numpy()
    return out


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sieve lets through: all that it was made of, and a few others."""
    at = keys & (len(held) * 64 - 1)
    return (held[at >> 6] >> (at & 63)) & 1 == 1


def bands_in(bands: DataFrame, keys: DataFrame) -> DataFrame:
    """t1, t2, n, b of the bands that are among the keys (and a few others)."""
    held = bands.sparkSession.sparkContext.broadcast(sieve(keys))

    def run(batches):
        for batch in batches:
            b = batch["bands"].flatten().to_numpy()
            at = np.flatnonzero(passes(held.value, b))
            take = pa.array(at // BANDS)
            yield pa.record_batch([batch[c].take(take) for c in ("t1", "t2", "n")] + [pa.array(b[at])], names=["t1", "t2", "n", "b"])

    return bands.select("t1", "t2", "n", "bands").mapInArrow(run, "t1 long, t2 long, n long, b long")


def gram_hashes_rows(x: np.ndarray) -> np.ndarray:
    """One hash for each row."""
    out = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        out = mix(out ^ x[:, j]) + np.uint64(j)
    return out


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id and s, the weighted shingles (64-bit elements, sorted), of texts with t1, t2, text."""

    def run(batches):
        for batch in batches:
            for rows, unit, elements in shingles(batch["text"]):
                ends = np.searchsorted(unit, np.arange(len(rows) + 1))
                sets = [elements[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([batch["id"].take(pa.array(rows)), pa.array(sets, pa.binary())], names=["id", "s"])

    return texts.select(_id().alias("id"), "text").mapInArrow(run, "id string, s binary")


def _id():
    return F.concat(F.hex("t1"), F.lit("-"), F.hex("t2"))


def components(links: DataFrame, tag: str) -> DataFrame:
    """v, c: each end of links (a, b) with the smallest end it is connected to.

    Every round takes the least label among neighbours, then the label's own label, until nothing changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-edges")
    hubs = hot_keys(edges, "b")
    labels = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select("v", F.least("v", "c").alias("c"))
    labels = materialize(labels, f"{tag}-labels")
    while True:
        near = spread_join(edges, labels.select(F.col("v").alias("b"), "c"), ["b"], ["a"], hot=hubs)
        near = near.groupBy(F.col("a").alias("v")).agg(F.min("c").alias("least"))
        moved = labels.join(near, "v").select("v", F.least("c", "least").alias("n"), F.col("c").alias("old"))
        moved = materialize(moved, f"{tag}-moved")
        hop = moved.select(F.col("v").alias("n"), F.col("n").alias("next"))
        new = spread_join(moved, hop, ["n"], ["v"]).select("v", F.least("n", "next").alias("c"), "old")
        new = materialize(new, f"{tag}-labels")
        labels = new.select("v", "c")
        if not new.where("c <> old").limit(1).count():
            return labels


def common_weights(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """The weight of what each two of the sets share."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.r_[True, values[1:] != values[:-1]][: len(values)]
    kind = np.cumsum(head) - 1
    shared = np.bincount(kind)[kind] > 1  # a value of one set is in no common set
    values, owner = values[shared], owner[shared]
    kind = np.cumsum(np.r_[True, values[1:] != values[:-1]][: len(values)]) - 1
    weight = weights_of(values).astype(np.float32)
    out = np.zeros((n, n))
    for a in range(0, int(kind[-1]) + 1 if len(kind) else 0, width):
        lo, hi = np.searchsorted(kind, (a, a + width))
        has, heavy = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        has[owner[lo:hi], kind[lo:hi] - a] = 1
        heavy[owner[lo:hi], kind[lo:hi] - a] = weight[lo:hi]
        out += heavy @ has.T  # whole numbers below 2**24: exact
    return out


def bucket_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the first one that it is connected to by pairs of the given similarity."""
    size = np.array([weights_of(x).sum() for x in sets], float)
    common = common_weights(sets)
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(sets)).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _met(open_: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between components, from members (b, i, j, id, c, s) of blocks of buckets."""

    def run(batches):
        held, key = [], None

        def links():
            if len({r[1] for r in held}) < 2:
                return None
            found = bucket_links([np.frombuffer(r[2], np.uint64) for r in held], threshold)
            pairs = [(held[i][0], held[k][0]) for i, k in enumerate(found) if k != i and held[i][1] != held[k][1]]
            return pa.record_batch([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["a", "b"]) if pairs else None

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("b", "i", "j", "id", "c", "s")]
            for b, i, j, ident, c, own in zip(*columns, strict=True):
                if (b, i, j) != key:
                    if held and (out := links()) is not None:
                        yield out
                    held, key = [], (b, i, j)
                held.append((ident, c, own))
        if held and (out := links()) is not None:
            yield out

    dealt = open_.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "id")
    return dealt.mapInArrow(run, "a string, b string")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """v, c: texts (as t1-t2 in hex) that share a band with another, with their component (the least v in it)."""
    texts = lambda: distinct_texts(docs)
    bands = materialize(banded(texts()), "op1-bands", free=True)
    shared = bands.select(F.explode("bands").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    shared = materialize(shared.where("rows > 1"), "op1-shared", free=True)
    most = max((shared.agg(F.sum("rows")).first()[0] or 0) // HOT, FEW)
    crowds = [r["h"] for r in shared.where(F.col("rows") > most).select(F.xxhash64("b").alias("h")).collect()]  # fewer than HOT
    members = materialize(spread_join(bands_in(bands, shared.select("b")), shared, ["b"], ["t1"], hot=crowds), "op1-members", free=True)
    sets = materialize(shingle_sets(texts().join(members.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")), "op1-sets", free=True)
    members = members.select("b", _id().alias("id"), "n", "rows")
    company = members.groupBy("id").agg(F.sum("rows").alias("w"))
    members = materialize(members.join(company, "id").select("b", "id", "n", "rows", "w"), "op1-company")

    # Each bucket's members against its centre.
    centres = members.groupBy("b").agg(F.min(F.struct((-F.col("w")).alias("o"), "id", "n")).alias("m"))
    others = spread_join(members, centres, ["b"], ["id"], hot=crowds).where("id <> m.id")
    others = materialize(others.select("b", "id", "n", "rows", F.col("m.id").alias("centre"), F.col("m.n").alias("n_centre")), "op1-others")
    pairs = others.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), F.least("n", "n_centre").alias("low"), F.greatest("n", "n_centre").alias("high"))
    pairs = materialize(pairs.where(f"low >= {threshold} * high - 1e-9").select("a", "b").distinct(), "op1-pairs")
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), ["a"], ["b"])
    both = spread_join(both, sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), ["b"], ["a"], hot=hot_keys(pairs, "b"))
    links = materialize(_similar(both, threshold), "op1-links", free=True)
    labels = members.select(F.col("id").alias("v")).distinct().join(components(links, "op1-first"), "v", "left").select("v", F.coalesce("c", "v").alias("c"))
    labels = materialize(labels, "op1-labels", free=True)

    # Buckets that hold several components besides the centre, which has met all of them, in blocks.
    known = others.join(labels, others["id"] == labels["v"]).select("b", "id", "rows", "c")
    several = known.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("b")
    many = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = spread_join(known, several, ["b"], ["id"], hot=crowds).withColumn("many", many).withColumn("x", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    blocks = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select("b", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "id", "c")
    joined = blocks.join(sets.select("id", "s"), "id")
    more = materialize(_met(joined, threshold), "op1-more", free=True)
    at = lambda x: labels.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
    between = more.join(at("a"), "a").join(at("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct()
    merged = components(between, "op1-second").select(F.col("v").alias("c"), F.col("c").alias("to"))
    merged = spread_join(labels, merged, ["c"], ["v"], "left")
    return materialize(merged.select("v", F.coalesce("to", "c").alias("c")), "op1-labels")


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (a, b, s_a, s_b: sorted elements) whose similarity reaches the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch["s_a"], batch["s_b"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                common = int(weights_of(both[1:][both[1:] == both[:-1]]).sum())
                if common >= threshold * (int(weights_of(both).sum()) - common) - 1e-9:
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.record_batch([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])

    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(run, "a string, b string")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t1, t2, class_id, class_size of every document."""
    labels = near_classes(docs, threshold).withColumnRenamed("v", "id")
    keyed = with_text_key(docs).select("doc_id", "t1", "t2", F.col("text").rlike(WORD).alias("words"))
    keyed = materialize(keyed.withColumn("id", _id()), "op1-keys")
    named = spread_join(keyed, labels, ["id"], ["doc_id"], "left").select("doc_id", "t1", "t2", F.when(F.col("words"), F.coalesce("c", "id")).alias("c"))
    named = materialize(named, "op1-named")
    sizes = named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    of_class = spread_join(named.where("c is not null"), sizes, ["c"], ["doc_id"]).select("doc_id", "t1", "t2", "class_id", "class_size")
    return of_class.unionByName(named.where("c is null").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one row of each class: that of the smallest doc_id (a null only if there is no other)."""
    found = classes(docs)
    first = found.groupBy(F.coalesce("class_id", F.lit(-1)).alias("k1"), F.when(F.col("class_id").isNull() | (F.col("class_size") == 1), F.concat_ws("-", "t1", "t2")).alias("k2"))
    first = first.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("m")).select("m.doc_id", "m.t1", "m.t2")
    keyed = docs.withColumns({"_t1": F.xxhash64(F.coalesce("text", F.lit(""))), "_t2": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    same = keyed["doc_id"].eqNullSafe(first["doc_id"]) & (keyed["_t1"] == first["t1"]) & (keyed["_t2"] == first["t2"])
    return keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"]).select(docs.columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
