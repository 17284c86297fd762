"""Mixing sources to target weights by a min-cost flow over membership patterns.

A text belongs to every source that has a document with it; that set of sources is its pattern. Documents
are summed by pattern and source, and a flow from patterns to sources carries words: a pattern's first pass
(its words divided by its sources, as each holds them) is free, each further pass costs one more a word, up
to MOST_COST; a source takes its quota, and from a pattern at most REPEATS times the words that its own
documents have there. So words that several sources hold are repeated last. As the cost of a word depends on
its pattern's pass alone, and what patterns can send at once is a polymatroid, the cheapest flow comes from
opening one pass after another and sending as much as the sources still take: each step is a maximum flow,
in phases of shortest paths.

The documents of a source in a pattern are then taken in an order seeded by their doc_id until the flow is
met. That order is cut into 65,536 ranges of hashes, so only the documents of the ranges where a pass ends
are ever put in order.

Quotas are computed by aggregations, however many sources there are. The flow is computed on the driver, for
the MOST_PATTERNS heaviest patterns of several sources; the documents of lighter ones count for their own
source alone, which meets the same quotas. Patterns of one source need no flow, and make up for what rounding
to whole documents leaves in the others.

Nulls: a null text has size 0, a null source is a source of its own and the last one, a null doc_id is
hashed as ''. Equal rows may take each other's place. Texts without words have their own source only. An
empty table gives an empty result; other columns are kept by mix() and dropped by the query.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, hot_keys, materialize, read, spread_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
#: The most patterns of several sources whose flow is computed.
MOST_PATTERNS = 20_000
#: The cost of a word in this pass and all later ones.
MOST_COST = 4


def level(sources: DataFrame, total: float, repeats: int) -> float:
    """What a unit of weight gets where targets stop at repeats * words: the shares of total, by weight, filled up.

    Sources that are at their cap below the level leave their rest to the others, until no other one is.
    """
    low, cap = -1.0, F.col("words") * float(repeats)
    while True:
        full = cap <= F.col("weight") * F.lit(low) if low >= 0 else F.lit(False)
        sums = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            return float("inf")
        found = (total - sums["used"]) / sums["open"]
        if found <= low:
            return found if low < 0 else low
        low = found


def numbered(sources: DataFrame) -> DataFrame:
    """sources with i, their place by code point (null last), without bringing them together."""
    spread = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "op3-sources")
    inner = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    parts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_many"))  # a row for each partition
    before = parts.withColumn("_before", F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.withColumn("_row", F.row_number().over(inner)).join(before.drop("_many"), "_part").withColumn("i", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


class _Network:
    """Maximum flows in a graph whose capacities may grow between them."""

    def __init__(self):
        self.ends, self.room, self.arcs = [], [], defaultdict(list)

    def arc(self, a, b, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.arcs[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(c)
        return len(self.ends) - 2

    def push(self, start, end) -> None:
        """Sends as much as there is room for, by shortest paths, all of one length at a time."""
        ends, room, arcs = self.ends, self.room, self.arcs
        while True:
            depth, queue = {start: 0}, deque([start])
            while queue and end not in depth:
                a = queue.popleft()
                for e in arcs[a]:
                    if room[e] and ends[e] not in depth:
                        depth[ends[e]] = depth[a] + 1
                        queue.append(ends[e])
            if end not in depth:
                return
            turn, path, a = dict.fromkeys(depth, 0), [], start
            while True:
                if a == end:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    cut = next(i for i, e in enumerate(path) if not room[e])
                    a = ends[path[cut] ^ 1]
                    path = path[:cut]
                    continue
                while turn[a] < len(arcs[a]):
                    e = arcs[a][turn[a]]
                    if room[e] and depth.get(ends[e], -1) == depth[a] + 1:
                        path.append(e)
                        a = ends[e]
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    a = ends[path.pop() ^ 1]
                    turn[a] += 1


def flow(patterns: dict, quotas: dict, repeats: int = REPEATS, most_cost: int = MOST_COST) -> dict:
    """Words that each pattern gives each of its sources: the cheapest way to meet the quotas as far as possible.

    patterns: for each pattern the words that its documents have in each of its sources; quotas: words wanted.
    """
    net, opening, links = _Network(), {}, {}
    for p, words in patterns.items():
        opening[p] = net.arc("start", ("pattern", p), 0)
        for s, n in words.items():
            links[p, s] = net.arc(("pattern", p), ("source", s), repeats * n)
    for s, q in quotas.items():
        net.arc(("source", s), "end", q)
    opened = dict.fromkeys(patterns, 0)
    for cost in range(most_cost + 1):
        for p, words in patterns.items():
            all_ = repeats * sum(words.values())
            more = all_ if cost == most_cost else min(all_, (cost + 1) * -(-sum(words.values()) // len(words)))
            net.room[opening[p]] += more - opened[p]
            opened[p] = more
        net.push("start", "end")
    return {p: {s: net.room[links[p, s] + 1] for s in words} for p, words in patterns.items()}


def sized(docs: DataFrame) -> DataFrame:
    """docs with _size, their words, _o, the seeded order, and _t1, _t2, 128 hash bits of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + SEED)).cast("binary"))
    return docs.withColumns({"_size": size, "_o": order, "_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})


def take(rows: DataFrame, slim: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with _passes, how often each is taken, given the words to take of each class (p) in each pass.

    rows and slim hold the same documents (p, _size, _o, doc_id; rows may have more). plan: p, words array<long>.
    """
    ranges = slim.groupBy("p", F.substring("_o", 1, 4).alias("_range")).agg(F.sum("_size").alias("inside"))
    by_range = Window.partitionBy("p").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("inside").over(by_range), F.lit(0)))  # 65,536 rows a class at most
    # The range in which each pass ends: all before it is taken, nothing after it.
    ends = ranges.join(plan, "p").select("p", "_range", "before", "inside", F.posexplode("words").alias("k", "w"))
    ends = ends.where("before <= w and w < before + inside").groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.col("_range").alias("r"), "before")))).alias("_ends"))
    known = materialize(plan.join(ends, "p", "left").select("p", F.col("words").alias("_words"), "_ends"), "op3-plan")
    # Spark sends `known` to every task if it is small, as its written size tells; else hot classes are dealt to many.
    marked = rows.join(known, "p").withColumn("_range", F.substring("_o", 1, 4))
    marked = marked.withColumn("_edge", F.coalesce(F.expr("exists(map_values(_ends), e -> e.r = _range)"), F.lit(False)))
    inner = Window.partitionBy("p", "_range").orderBy("_o", "_size", "doc_id", "_t1", "_t2").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.where("_edge").withColumn("_ahead", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    outside = marked.where("not _edge").withColumn("_ahead", F.lit(0).cast("long"))
    passes = """aggregate(sequence(0, size(_words) - 1), 0, (n, k) -> n + CASE
        WHEN _words[k] <= 0 THEN 0 WHEN _ends[k] IS NULL THEN 1 WHEN _range < _ends[k].r THEN 1 WHEN _range > _ends[k].r THEN 0
        WHEN 2 * (_ends[k].before + _ahead) + _size <= 2 * _words[k] THEN 1 ELSE 0 END)"""
    taken = outside.unionByName(inside).withColumn("_passes", F.expr(passes))
    return taken.drop("_words", "_ends", "_range", "_edge", "_ahead")


def _own():
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def shared_texts(slim: DataFrame, most: int = MOST_PATTERNS) -> tuple[DataFrame, dict]:
    """_t1, _t2, _pattern of the texts that several sources hold; and those patterns' words in each source (own)."""
    many = slim.where("_size > 0").groupBy("_t1", "_t2").agg(F.sort_array(F.collect_set("_own")).alias("of")).where("size(of) > 1")
    many = materialize(many.select("_t1", "_t2", F.hex(F.xxhash64("of")).alias("_pattern")), "op3-shared")
    sums = spread_join(slim.where("_size > 0"), many, ["_t1", "_t2"], ["doc_id"]).groupBy("_pattern", "_own").agg(F.sum("_size").alias("words"))
    sums = materialize(sums, "op3-patterns")
    heavy = sums.groupBy("_pattern").agg(F.sum("words").alias("all")).orderBy(F.desc("all"), "_pattern").limit(most).select("_pattern")
    patterns: dict = defaultdict(dict)
    for r in sums.join(F.broadcast(heavy), "_pattern").collect():  # at most `most` patterns
        patterns[r["_pattern"]][r["_own"]] = r["words"]
    return many.join(F.broadcast(heavy), "_pattern").select("_t1", "_t2", "_pattern"), dict(patterns)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, whole: bool = False) -> DataFrame:
    """The documents (doc_id, text, source) with p (source and pattern), _size, _passes, source_size and target.

    _passes: how often the mix takes the document. whole: with all columns of docs, else without its text
    and other columns.
    """
    spark = docs.sparkSession
    slim = materialize(sized(docs.select("doc_id", "text", "source").withColumn("_own", _own())).drop("text"), "op3-sizes")
    sources = numbered(slim.groupBy("_own", "source").agg(F.sum("_size").alias("words")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    sources = materialize(sources.select("_own", "source", "words", weight.alias("weight")), "op3-weights")
    total = share * (sources.agg(F.sum("words")).first()[0] or 0)
    target = F.least(F.col("words") * float(repeats), F.col("weight") * F.lit(level(sources, total, repeats)))
    sources = materialize(sources.select("_own", F.col("words").alias("source_size"), target.alias("target")), "op3-targets")

    # Patterns of several sources, with what their sources have for themselves.
    shared, patterns = shared_texts(slim)
    named = sorted({s for words in patterns.values() for s in words})
    few = spark.createDataFrame([(s,) for s in named], "_own string")
    held = sources.join(F.broadcast(few), "_own").collect()  # at most the sources of MOST_PATTERNS patterns
    alone = {(r["_own"],): {r["_own"]: r["source_size"] - sum(w.get(r["_own"], 0) for w in patterns.values())} for r in held}
    quotas = {r["_own"]: int(r["target"]) for r in held}
    given = flow({**alone, **patterns}, quotas, repeats)
    # Cheap passes first: the first pass over all documents of a class, then the next.
    steps = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.greatest(F.lit(0), F.least(F.col("words"), F.col("flow") - k * F.col("words"))))
    planned = lambda rows: rows.select(F.concat("pattern", F.lit(":"), "_own").alias("p"), steps.cast("array<long>").alias("words"))
    columns = "pattern string, _own string, words long, flow long"

    hot = hot_keys(slim, "_t1", "_t2") if patterns else None

    def classed(rows):
        if patterns:
            rows = spread_join(rows, shared, ["_t1", "_t2"], ["doc_id"], "left", hot=hot)
        else:
            rows = rows.withColumn("_pattern", F.lit(None).cast("string"))
        return rows.withColumn("p", F.concat(F.coalesce("_pattern", F.lit("")), F.lit(":"), "_own")).drop("_pattern")

    slim = materialize(classed(slim), "op3-classes")
    plan = planned(spark.createDataFrame([(p, s, n, given[p][s]) for p, words in patterns.items() for s, n in words.items()], columns))
    if patterns:
        # Whole documents are taken, so patterns come out a little off; the sources' own documents make up for it.
        of_patterns = slim.where("not startswith(p, ':')")
        done = take(of_patterns, of_patterns, plan).groupBy("_own").agg(F.sum(F.col("_size") * F.col("_passes")).alias("words"))
        for r in done.collect():  # at most the sources of MOST_PATTERNS patterns
            words = alone[(r["_own"],)][r["_own"]]
            given[(r["_own"],)][r["_own"]] = min(max(quotas[r["_own"]] - r["words"], 0), repeats * words)
    mine = planned(spark.createDataFrame([("", s, alone[(s,)][s], given[(s,)][s]) for s in named], columns))
    rest = planned(sources.join(F.broadcast(few), "_own", "left_anti").select(F.lit("").alias("pattern"), "_own", F.col("source_size").alias("words"), F.floor("target").cast("long").alias("flow")))
    plan = materialize(plan.unionByName(mine).unionByName(rest), "op3-flow")
    rows = classed(sized(docs.withColumn("_own", _own()))) if whole else slim
    return take(rows, slim, plan).join(sources, "_own").drop("_o", "_t1", "_t2", "_own")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_passes")).alias("taken"))
