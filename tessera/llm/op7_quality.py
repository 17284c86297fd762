"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers; each is cut into bins at quantiles of the training sample. Training
goes round the features, adding to each one's table a small step of a shallow tree on its bins (logistic
boosting); then the pairs of features whose joint table explains most of what is left get tables of their
own, boosted likewise. A score is the sum of table entries, added by array operations for whole batches.

Null and empty texts get a score like any other (their numbers are zeros). Null labels do not train. A
table without usable labels of both kinds gives every text the mean label (0.5 if none). Repeated rows are
scored alike. Only the text is an input of a score.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BASE, SEGMENT, Rolling, read, text_bytes
from tessera.llm.windows import _SPACE, words_in

#: The most labelled rows that train; with more, those of least hash are taken.
SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
RATE = 0.1

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "punct", "symbol", "high", "line_words",
    "words_with_symbol", "words_upper", "short_words", "long_words", "distinct_words", "same_as_last", "distinct_pairs",
    "bars", "exclaims", "sentence_end", "lines", "distinct_lines", "title_words", "vowels",
)


def _kinds() -> np.ndarray:
    kind = np.zeros((7, 256), np.float32)  # upper, digit, space, punct, symbol, high, vowel
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"-()", b"#$%&*@^~<>=+_|\\/{}[]`", bytes(range(128, 256)), b"aeiouAEIOU")):
        kind[i, list(chars)] = 1
    return kind


def _sums(part: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """What adds up over the parts of a text, for adjoining texts part[starts[i]:stops[i]] from 0 on; and their words.

    Returns a row of sums for each text (bytes of each kind, bars, exclaims, bytes, words, and of words: bytes,
    with symbols, upper, short, long, ends of sentences, titles), the words' hashes, their texts and the hashes' source.
    """
    kinds, n = _kinds(), len(starts)
    some = np.flatnonzero(stops > starts)
    out = np.zeros((n, 18))

    def total(column, x):
        out[some, column] = np.add.reduceat(x, starts[some], dtype=np.float64)

    if len(some):
        for k in range(7):
            total(k, kinds[k][part])
        total(7, part == 0x7C)
        total(8, part == 0x21)
    out[:, 9] = stops - starts
    roll = Rolling(part)
    first, last, count = words_in(part, starts, stops)
    owner = np.repeat(np.arange(n), count)
    out[:, 10] = count
    if len(first):
        symbols = np.concatenate([[0], np.cumsum(kinds[4][part], dtype=np.float64)])
        uppers = np.concatenate([[0], np.cumsum(kinds[0][part], dtype=np.float64)])
        length = (last - first).astype(float)
        each = (length, symbols[last] > symbols[first], uppers[last] - uppers[first] > 0.6 * length, length < 4, length > 10, np.isin(part[last - 1], np.frombuffer(b".!?", np.uint8)), kinds[0][part[first]])
        for k, x in enumerate(each):
            out[:, 11 + k] = np.bincount(owner, x, n)
    return out, roll.of(first, last), owner, roll


def _distinct(keys: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(keys, return_index=True)
    return np.bincount(owners[at], minlength=n)


def _ratios(sums: np.ndarray, distinct_words, same, distinct_pairs, lines, distinct_lines) -> np.ndarray:
    """The features of texts from their sums and counts."""
    out = np.zeros((len(sums), len(FEATURES)))
    size, count = sums[:, 9], sums[:, 10]
    per_byte, words = sums[:, :7] / np.maximum(size, 1)[:, None], np.maximum(count, 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(count), sums[:, 11] / words
    out[:, 3:9] = per_byte[:, :6]
    out[:, 9] = np.log1p(count / np.maximum(lines, 1))
    out[:, 10:14] = sums[:, 12:16] / words[:, None]
    out[:, 14], out[:, 15], out[:, 16] = distinct_words / words, same / words, distinct_pairs / words
    out[:, 17], out[:, 18], out[:, 19] = sums[:, 7] / words, sums[:, 8] / words, sums[:, 16] / words
    out[:, 20], out[:, 21] = np.log1p(lines), distinct_lines / np.maximum(lines, 1)
    out[:, 22], out[:, 23] = sums[:, 17] / words, per_byte[:, 6]
    return out


_OWNER, _BEFORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_counts(hashes: np.ndarray, owner: np.ndarray, n: int):
    """Different words, words equal to the one before, and different pairs of neighbours of each text."""
    own = hashes ^ (owner.astype(np.uint64) * _OWNER)
    follows = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
    before = np.where(follows, np.r_[np.uint64(0), hashes[:-1]][: len(hashes)], np.uint64(0))
    same = np.bincount(owner, follows & (before == hashes), n)
    return _distinct(own, owner, n), same, _distinct(own ^ (before * _BEFORE), owner, n)


def _long_features(text: np.ndarray, size: int) -> np.ndarray:
    """The features of one long text, read in parts that end before white space."""
    sums, hashes, lines, open_, at = np.zeros((1, 18)), [], [], None, 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and not _SPACE[text[stop]]:
            ahead = np.flatnonzero(_SPACE[text[stop : stop + size]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + size, len(text))
        part = text[at:stop]
        more, own, _, roll = _sums(part, np.array([0]), np.array([len(part)]))
        sums += more
        hashes.append(own)
        edge = np.unique(np.r_[0, np.flatnonzero(part == 10) + 1, len(part)])
        begin, end = edge[:-1], edge[1:]
        raw = (roll.sums[end] - roll.sums[begin]) * roll.ipw[begin]
        if open_ is not None:  # a line that began in a part before
            raw[:1] = raw[:1] * np.uint64(pow(BASE, open_[1], 1 << 64)) + open_[0]
        if part[-1] != 10 and stop < len(text):
            open_ = raw[-1], int(end[-1] - begin[-1]) + (open_[1] if open_ is not None and len(raw) == 1 else 0)
            raw = raw[:-1]
        else:
            open_ = None
        lines.append(raw)
        at = stop
    words, lines = np.concatenate(hashes), np.concatenate(lines)
    counts = _word_counts(words, np.zeros(len(words), np.int64), 1)
    return _ratios(sums, *counts, np.array([len(lines)]), np.array([len(np.unique(lines))]))


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text of a column without nulls. Long texts are read in parts; the numbers are the whole text's."""
    data, offsets = text_bytes(column)
    out, size, i = np.zeros((len(offsets) - 1, len(FEATURES))), SEGMENT, 0
    while i < len(out):
        if offsets[i + 1] - offsets[i] > size:
            out[i] = _long_features(data[offsets[i] : offsets[i + 1]], size)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        n, starts, stops = j - i, offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        if len(part):
            sums, hashes, owner, roll = _sums(part, starts, stops)
            breaks = np.zeros(len(part) + 1, bool)
            breaks[starts] = True
            breaks[np.flatnonzero(part == 10) + 1] = True
            breaks[-1] = True
            edge = np.flatnonzero(breaks)
            line_owner = np.searchsorted(stops, edge[:-1], "right")
            line_hash = roll.of(edge[:-1], edge[1:]) ^ (line_owner.astype(np.uint64) * _OWNER)
            out[i:j] = _ratios(sums, *_word_counts(hashes, owner, n), np.bincount(line_owner, minlength=n), _distinct(line_hash, line_owner, n))
        i = j
    return out


# ---- the model ----------------------------------------------------------------------------------


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """The step of a shallow tree over ordered bins: up to `leaves` ranges, split greedily by gain."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    ranges = [(0, len(grad))]
    while len(ranges) < leaves:
        best = (1e-6, None)
        for a, b in ranges:
            at = np.arange(a + 1, b)
            if len(at):
                gain = np.where(np.minimum(h[at] - h[a], h[b] - h[at]) >= least, worth(a, at) + worth(at, b) - worth(a, b), 0)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), (a, b, int(at[k]))), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b, m = best[1]
        ranges = [r for r in ranges if r != (a, b)] + [(a, m), (m, b)]
    step = np.zeros(len(grad))
    for a, b in ranges:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return step


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: cuts and tables of each feature and of the chosen pairs, and the intercept."""
    n, d = x.shape
    if not n or y.min() == y.max():
        p = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
        return {"base": np.log(p / (1 - p)), "cuts": [], "tables": [], "coarse": [], "pairs": []}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(d)]
    binned = [np.searchsorted(cuts[j], x[:, j], "right") for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    p = y.mean()
    score = np.full(n, np.log(p / (1 - p)))
    base = float(score[0])
    for _ in range(ROUNDS):
        for j in range(d):
            q = 1 / (1 + np.exp(-score))
            step = RATE * _tree(np.bincount(binned[j], y - q, len(tables[j])), np.bincount(binned[j], q * (1 - q), len(tables[j])))
            tables[j] += step
            score += step[binned[j]]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(d)]
    q = 1 / (1 + np.exp(-score))
    worth = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = small[i] * PAIR_BINS + small[j]
            g, h = np.bincount(cell, y - q, PAIR_BINS**2), np.bincount(cell, q * (1 - q), PAIR_BINS**2)
            worth.append((-float((g**2 / (h + 1)).sum()), i, j))
    pairs = [(i, j, np.zeros(PAIR_BINS**2)) for _, i, j in sorted(worth)[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for i, j, table in pairs:
            cell = small[i] * PAIR_BINS + small[j]
            q = 1 / (1 + np.exp(-score))
            g, h = np.bincount(cell, y - q, PAIR_BINS**2), np.bincount(cell, q * (1 - q), PAIR_BINS**2)
            order = np.argsort(g / (h + 1.0), kind="stable")  # ranges of cells of like slope
            step = np.zeros(PAIR_BINS**2)
            step[order] = RATE * _tree(g[order], h[order])
            table += step
            score += step[cell]
    return {"base": base, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1, by additions of table entries."""
    total = np.full(len(x), model["base"])
    for j, (c, table) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        total += table[np.searchsorted(c, x[:, j], "right")]
    small = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model["coarse"])]
    for i, j, table in model["pairs"]:
        total += table[small[i] * PAIR_BINS + small[j]]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


# ---- on tables ----------------------------------------------------------------------------------


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of docs and x (the features) for each row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(batch["_text"]).ravel(), pa.float64()), len(FEATURES))
            yield pa.record_batch([*(batch[c] for c in columns), x.cast(pa.list_(pa.float64()))], names=[*columns, "x"])

    own = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    return own.mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Learns from at most `sample` labelled rows (of least hash), never from held-out ones."""
    known = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = F.xxhash64(F.lit(7), "doc_id")
    chosen = known.select("doc_id", "y").orderBy(order, "doc_id").limit(sample)
    # chosen has at most `sample` rows of two numbers, so it may be sent to every task.
    # Of rows with one doc_id the text of least hash counts, so that training again gives the same model.
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = measured(known, "doc_id", "y").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: dict, *columns: str) -> DataFrame:
    """The named columns of docs, held_out, score and predicted."""
    frozen = pickle.dumps(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        own = pickle.loads(frozen)
        for batch in batches:
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in batch["doc_id"].to_pylist()]
            p = score(own, features(batch["_text"]))
            yield pa.record_batch([*(batch[c] for c in columns), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*columns, "held_out", "score", "predicted"])

    own = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    return own.mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels")), "doc_id")
