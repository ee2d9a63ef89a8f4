"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words once
at no cost, a second time at cost 1, a third time at cost 3 and so on (convex), and a min-cost flow routes them to the
quotas of the sources. What flows out of a pattern is then drawn from its documents in a seeded order: whole passes over
all of them first, then documents from the front of the order, skipping those too large for what is left, and at last
exchanges of single documents near the cut that bring the words taken closer to what flows.

The order is that of a hash of (id, text). Its cut is found by histograms of the hash that are refined around the cut, as
tables with a window over the cells of one pattern; documents near the cut, at most about NEAR_DOCS of a pattern, are
then chosen in one small task per pattern. So no task sorts a source, and only one row per pattern, or a few numbers,
reach the driver. Rows that agree in id and text are one item with a number of copies, and of those as many are taken as
it needs. Of overlapping sources at most `max_patterns` patterns are routed (else an error). Plain sources don't
compete, so that each one's flow is its quota; over that number their targets are found in Spark, without a limit.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are
taken 0 times, and so are those with a null array of sources. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.skew import attach, number_equal_rows
from tidewater.sources.work import materialize

MAX_REPEATS = 3
SEED = 17
MAX_PATTERNS = 20_000
#: Documents about a pattern's cut that one task chooses from, and bits by which the hash is refined.
NEAR_DOCS, STEP_BITS, HASH_BITS = 4096, 12, 60
#: Exchanges of documents near the cut, tried while a pattern is further off than this share.
SWAPS, CLOSE_ENOUGH = 8, 0.0002


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")).cast("long")


def capped_targets(sizes: list[int], weights: list[float], max_repeats: float = MAX_REPEATS, total: float | None = None) -> list[float]:
    """Shares of `total` (sum(sizes) where not given) by weight; none over max_repeats times its size, the excess reshared by weight."""
    target = [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes)], float(sum(sizes) if total is None else total)
    while free:
        whole = sum(weights[i] for i in free)
        if not whole:
            break
        over = [i for i in free if left * weights[i] / whole > max_repeats * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = float(max_repeats * sizes[i])
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


class _Network:
    """Min-cost flow where only the arcs out of the start cost something.

    A cheapest path is then one whose first arc is cheapest, so the flow is filled cost by cost; within a cost by
    blocking flows along shortest paths. Later paths never take back what an earlier first arc carries.
    """

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = defaultdict(list)
        self.head: list[object] = []
        self.room: list[int] = []
        self.first: dict[int, list[int]] = defaultdict(list)  # cost -> arcs out of the start
        self.tail: list[object] = []

    def add(self, a: object, b: object, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.head))
            self.tail.append(x)
            self.head.append(y)
            self.room.append(r)
        return len(self.head) - 2

    def add_first(self, b: object, room: int, cost: int) -> int:
        arc = self.add("from", b, room)
        self.first[cost].append(arc)
        return arc

    def fill(self) -> None:
        open_: list[int] = []
        for cost in sorted(self.first):
            open_ += self.first[cost]
            while self._blocking_flow([e for e in open_ if self.room[e] > 0]):
                pass

    def _blocking_flow(self, first: list[int]) -> bool:
        level, queue = {self.head[e]: 1 for e in first}, deque(dict.fromkeys(self.head[e] for e in first))
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.head[e]
                if self.room[e] > 0 and b != "from" and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if "to" not in level:
            return False
        at = dict.fromkeys(level, 0)
        for start in first:
            while self.room[start] > 0:
                path, node = [start], self.head[start]
                while node != "to":
                    arcs = self.out[node]
                    while at[node] < len(arcs) and not (self.room[arcs[at[node]]] > 0 and level.get(self.head[arcs[at[node]]], 0) == level[node] + 1):
                        at[node] += 1
                    if at[node] < len(arcs):
                        path.append(arcs[at[node]])
                        node = self.head[path[-1]]
                    elif len(path) == 1:
                        break
                    else:
                        node = self.tail[path.pop()]
                        at[node] += 1
                if node != "to":
                    break
                amount = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
        return True


def repeat_cost(repeat: int) -> int:
    """What a word costs the second time (1), the third (3), the fourth (6) ..."""
    return repeat * (repeat + 1) // 2


def route(patterns: dict[tuple, int], quotas: dict[object, int], max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources) gives, from its words and the sources' quotas: the most that the quotas
    take, at the least cost.
    """
    net, arcs = _Network(), defaultdict(list)
    for p, words in patterns.items():
        for repeat in range(max_repeats if p else 0):
            arcs[p].append(net.add_first(("pattern", p), words, repeat_cost(repeat)))
        for s in p:
            net.add(("pattern", p), ("source", s), max_repeats * words)
    for s in {s for p in patterns for s in p}:
        net.add(("source", s), "to", quotas.get(s, 0))
    net.fill()
    return {p: sum(words - net.room[e] for e in arcs[p]) for p, words in patterns.items()}


def take_near(sizes: np.ndarray, copies: np.ndarray, wanted: int) -> np.ndarray:
    """How many copies of each item to take so that their words come near `wanted`; items in their order."""
    taken, gap = np.zeros(len(sizes), np.int64), int(wanted)
    for i in range(len(sizes)):
        if 0 < sizes[i] <= gap:
            taken[i] = min(int(copies[i]), gap // int(sizes[i]))
            gap -= int(taken[i]) * int(sizes[i])
    for _ in range(SWAPS):
        if abs(gap) <= CLOSE_ENOUGH * wanted:
            break
        some, more = np.flatnonzero((taken > 0) & (sizes > 0)), np.flatnonzero((taken < copies) & (sizes > 0))
        more = more[np.argsort(sizes[more], kind="stable")]
        out, add = np.append(0, sizes[some]), np.append(0, sizes[more])  # with doing nothing on either side
        at = np.searchsorted(add, out + gap)
        near = np.stack([np.clip(at - 1, 0, len(add) - 1), np.clip(at, 0, len(add) - 1)])
        left = np.abs(gap + out - add[near])
        side, i = np.unravel_index(np.argmin(left), left.shape)
        if left[side, i] >= abs(gap):
            break
        j = near[side, i]
        gap += int(out[i]) - int(add[j])
        if i:
            taken[some[i - 1]] -= 1
        if j:
            taken[more[j - 1]] += 1
    return taken


_CHOICE = "__pid long, __cut long, __picks array<long>, __drops array<long>, __partial array<struct<u: long, m: long>>"


def _choose(items: DataFrame, plan: DataFrame) -> DataFrame:
    """Each pattern's choice beyond full passes, from items (__pid, __u, size, copies) and a plan (__pid, rest).

    Items with a hash up to __cut are taken once more, but for __drops; __picks are taken beside; of the items named in
    __partial only m copies are.
    """
    open_, depth, ends = materialize(plan.filter("rest > 0").select("__pid", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "mix_open"), 0, []
    in_order = Window.partitionBy("__pid").orderBy("cell")
    while depth < HASH_BITS:
        depth = min(depth + STEP_BITS, HASH_BITS)
        inside = F.shiftright("__u", HASH_BITS - depth + STEP_BITS) == F.col("prefix")
        cells = attach(items, open_, "__pid", "__u").filter(inside).groupBy("__pid", F.shiftright("__u", HASH_BITS - depth).alias("cell"))
        # At most 2^STEP_BITS cells of a pattern.
        cells = cells.agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        cells = cells.withColumn("words_to", F.col("before") + F.sum("words").over(in_order)).withColumn("n_to", F.sum("n").over(in_order))
        cut = F.when((F.col("words_to") > F.col("rest")) & (F.col("words_to") - F.col("words") <= F.col("rest")), F.struct("cell", "n", F.col("n_to").alias("n_to"), F.col("words_to"), F.col("words")))
        cells = cells.withColumn("cut", F.max(cut).over(Window.partitionBy("__pid")))
        cells = materialize(cells, "mix_cells")
        # Cells about the cut that hold few enough items together.
        around = (F.col("n_to") <= F.col("cut.n_to") - F.col("cut.n") + NEAR_DOCS) & (F.col("n_to") - F.col("n") >= F.col("cut.n_to") - F.col("cut.n") - NEAR_DOCS // 2)
        near = cells.filter((F.col("cut.n") <= NEAR_DOCS) & around)
        ends.append(near.groupBy("__pid").agg(
            F.first("rest").alias("rest"), F.min(F.struct("cell", (F.col("words_to") - F.col("words")).alias("w"))).alias("lo"), F.max("cell").alias("hi"),
        ).select("__pid", "rest", F.col("lo.w").alias("before"), F.shiftleft("lo.cell", HASH_BITS - depth).alias("lo"), (F.shiftleft(F.col("hi") + 1, HASH_BITS - depth) - 1).alias("hi")))
        open_ = cells.filter((F.col("cell") == F.col("cut.cell")) & (F.col("n") > NEAR_DOCS)).select("__pid", "rest", F.col("cell").alias("prefix"), (F.col("words_to") - F.col("words")).alias("before"))
        if not open_.head(1):
            break
    ranges = ends[0]
    for more in ends[1:]:
        ranges = ranges.unionByName(more)
    near = attach(items, materialize(ranges, "mix_ranges"), "__pid", "__u").filter(F.col("__u").between(F.col("lo"), F.col("hi")))

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__u")
        u, size, copies = (rows[c].to_numpy(np.int64) for c in ("__u", "size", "copies"))
        taken = take_near(size, copies, int(rows["rest"].iloc[0] - rows["before"].iloc[0]))
        full, part = taken == copies, (taken > 0) & (taken < copies)
        # The cut that leaves the fewest exceptions: items before it that are not taken, items after it that are.
        edge = int(np.argmin(np.append(0, np.cumsum(~full)) + full.sum() - np.append(0, np.cumsum(full))))
        cut = int(u[edge - 1]) if edge else int(rows["lo"].iloc[0]) - 1
        after = np.arange(len(u)) >= edge
        drops, picks = u[~after & (taken == 0)], u[after & full & (taken > 0)]
        return pd.DataFrame({"__pid": [key[0]], "__cut": [cut], "__picks": [picks.tolist()], "__drops": [drops.tolist()], "__partial": [[{"u": int(a), "m": int(b)} for a, b in zip(u[part], taken[part])]]})

    # About 1.5 NEAR_DOCS rows of a pattern.
    return materialize(near.select("__pid", "__u", "size", "copies", "rest", "before", "lo").groupBy("__pid").applyInPandas(choose, _CHOICE), "mix_choice")


def _sources_in_spark(sizes: DataFrame, weights: dict[object, float] | None, max_repeats: int) -> DataFrame:
    """(__pid, source, source_size, target) of plain sources (source, words), by the same rule as capped_targets()."""
    spark = sizes.sparkSession
    ordered = materialize(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("__m", F.monotonically_increasing_id()), "mix_sources")
    parts = ordered.groupBy(F.shiftright("__m", 33).alias("__part")).count()  # a row for each task of the sort
    parts = parts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__from"))
    placed = ordered.withColumn("__part", F.shiftright("__m", 33)).join(F.broadcast(parts), "__part")
    placed = placed.select("source", "words", (F.col("__from") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias("__pid"))
    if weights:
        given = spark.createDataFrame(list(weights.items()), T.StructType([T.StructField("__s", sizes.schema["source"].dataType), T.StructField("weight", T.DoubleType())]))
        placed = placed.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))  # the caller's table
    else:
        placed = placed.withColumn("weight", (F.col("__pid") % 3 + 1).cast("double"))
    placed = materialize(placed, "mix_weights")
    total, left, whole, capped = placed.agg(F.sum("words")).first()[0] or 0, 0.0, 1.0, -1
    while True:  # the words left for a unit of weight only rise, so a source over its cap stays there
        share = F.col("weight") * left / whole
        over = share > max_repeats * F.col("words")
        sums = placed.agg(F.sum(F.when(over, max_repeats * F.col("words")).otherwise(0)).alias("caps"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if sums["n"] == capped or not sums["free"]:
            break
        capped, left, whole = sums["n"], float(total - sums["caps"]), sums["free"]
    target = F.when(over, (max_repeats * F.col("words")).cast("double")).otherwise(share)
    return placed.select("__pid", "source", F.col("words").alias("source_size"), target.alias("target"))


def _routed(found: list, weights: dict[object, float] | None, max_repeats: int) -> tuple[list[tuple], list[tuple]]:
    """(pattern, __pid, __full, rest) rows and (source, source_size, target) rows, from the rows (__pattern, words)."""
    patterns = {tuple(r["__pattern"]): r["words"] for r in found if r["__pattern"] is not None}
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s if s is not None else ""))
    size_of = dict.fromkeys(sources, 0)
    for p, words in patterns.items():
        for s in p:
            size_of[s] += words
    weight = [float(weights.get(s, 0)) if weights else float(i % 3 + 1) for i, s in enumerate(sources)]
    # Overlapping sources share documents: what is mixed in total is the words there are, each counted once.
    target = capped_targets([size_of[s] for s in sources], weight, max_repeats, sum(words for p, words in patterns.items() if p))
    given = route(patterns, {s: round(t) for s, t in zip(sources, target, strict=True)}, max_repeats)
    rows = [(list(p), i, given[p] // w if w else 0, given[p] % w if w else 0) for i, (p, w) in enumerate(patterns.items())]
    return rows, [(s, size_of[s], float(t)) for s, t in zip(sources, target, strict=True)]


def mix(docs: DataFrame, members: str, weights: dict[object, float] | None = None, doc_id: str = "doc_id", text: str = "text",
        max_repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """How often each document of `docs` is taken.

    `members` is an array column with the sources a document belongs to, or a plain column with its only source.
    `weights` maps a source to its weight; without it the sources by code point (null last) weigh 1, 2, 3, 1, 2, 3 ...
    Returns (columns of docs with size, copies and taken, a table of the sources: source, source_size, target).
    """
    spark, columns = docs.sparkSession, docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(columns))])
    at = {c: F.col(f"__c{i}") for i, c in enumerate(columns)}
    kind = docs.schema[members].dataType
    overlapping = isinstance(kind, T.ArrayType)
    kind = kind.elementType if overlapping else kind
    pattern = F.sort_array(F.array_distinct(at[members])) if overlapping else F.array(at[members])
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), at[doc_id], at[text]), 64 - HASH_BITS)
    sized = inner.withColumn("__pattern", pattern).withColumn("size", word_count(at[text])).withColumn("__u", hashed)
    narrow = sized.groupBy("__pattern", "__u", "size").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("__pattern").isNotNull())
    narrow = materialize(narrow, "mix_sizes")
    totals = materialize(narrow.groupBy("__pattern").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "mix_totals")
    n = totals.count()
    plan_schema = T.StructType([T.StructField("__p", T.ArrayType(kind)), *(T.StructField(c, T.LongType()) for c in ("__pid", "__full", "rest"))])
    if n <= max_patterns:
        rows, source_rows = _routed(totals.collect(), weights, max_repeats)  # at most max_patterns rows
        plan = materialize(spark.createDataFrame(rows, plan_schema), "mix_plan")
        source_schema = T.StructType([T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
        sources = spark.createDataFrame(source_rows, source_schema)
    elif overlapping:
        raise ValueError(f"over {max_patterns} membership patterns; group the sources first or raise max_patterns")
    else:
        sources = materialize(_sources_in_spark(totals.select(F.col("__pattern")[0].alias("source"), "words"), weights, max_repeats), "mix_targets")
        words, flow = F.nullif(F.col("source_size"), F.lit(0)), F.round("target").cast("long")
        plan = sources.select(F.array("source").alias("__p"), "__pid", F.coalesce(F.floor(flow / words), F.lit(0)).cast("long").alias("__full"), F.coalesce(flow % words, F.lit(0)).alias("rest"))
        plan, sources = materialize(plan, "mix_plan"), sources.drop("__pid")
    key = plan.select(F.xxhash64("__p").alias("__key"), "__p", "__pid", "__full", "rest")
    items = attach(narrow.withColumn("__key", F.xxhash64("__pattern")), key, "__key", "__u").filter(F.col("__pattern").eqNullSafe(F.col("__p")))
    items = materialize(items.select("__pid", "__u", "size", "copies"), "mix_items")
    chosen = plan.join(_choose(items, plan), "__pid", "left").select(F.xxhash64("__p").alias("__key"), "__p", "__full", "__cut", "__picks", "__drops", "__partial")
    chosen = materialize(chosen, "mix_chosen")
    keyed = sized.withColumn("__key", F.xxhash64("__pattern"))
    placed = attach(keyed, chosen, "__key", "__u", "left")
    placed = placed.withColumn("__m", F.get(F.filter("__partial", lambda x: x["u"] == F.col("__u")), F.lit(0))["m"])
    once = ((F.col("__u") <= F.col("__cut")) & ~F.array_contains("__drops", F.col("__u"))) | F.array_contains("__picks", F.col("__u"))
    if chosen.filter(F.size("__partial") > 0).head(1):  # some of several equal rows are taken
        wanted = [f"__c{i}" for i in range(len(columns))] + ["size", "__full", "__u", "__m"]
        some = number_equal_rows(placed.filter(F.col("__m").isNotNull()).select(*wanted), ["__u"], "__place").withColumn("__once", F.col("__place") < F.col("__m")).drop("__place")
        placed = placed.filter(F.col("__m").isNull()).select(*wanted, once.alias("__once")).unionByName(some)
    else:
        placed = placed.withColumn("__once", once)
    copies = F.when(F.col("size") > 0, F.col("__full") + F.coalesce(F.col("__once"), F.lit(False)).cast("long")).otherwise(0)
    placed = placed.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long"))
    out = placed.select(*[at[c].alias(c) for c in columns if c not in ("size", "copies", "taken")], "size", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    return out, sources


def mixed_documents(docs: DataFrame, members: str = "source", **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the same columns."""
    clash = [c for c in docs.columns if c in ("size", "copies", "taken")]
    if clash:
        back = {c: f"__kept_{c}" for c in clash}
        return mixed_documents(docs.withColumnsRenamed(back), members, **options).withColumnsRenamed({v: k for k, v in back.items()})
    out, _ = mix(docs, members, **options)
    return out.filter("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def with_targets(taken: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """The rows that mix() gives, with their source's source_size and target."""
    keyed = taken.withColumn("__key", F.xxhash64(source)).withColumn("__salt", F.monotonically_increasing_id())
    sources = sources.select(F.xxhash64("source").alias("__key"), F.col("source").alias("__s"), "source_size", "target")
    joined = attach(keyed, sources, "__key", "__salt").filter(F.col(source).eqNullSafe(F.col("__s")))
    return joined.drop("__key", "__salt", "__s")
