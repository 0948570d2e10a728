"""Mix sources to target weights: a min-cost flow over membership patterns, then seeded documents.

Documents with the same set of sources are interchangeable to the flow, so Spark reduces them to one
row per set. The flow sends words from patterns through sources to their quotas; the first copy of
a word is free, each further one costs more than the last (convex), so nothing is repeated before
everything usable has been taken once. Spark then picks whole documents in the order of a seeded hash
up to each pattern's share, and narrows the rest of the gap by the documents whose change fits it best.

Only the pattern table reaches the driver: one row per distinct set of sources, not of documents. Where it
has more than ``MAX_PATTERNS`` rows, targets are found in Spark, and the flow gets only what it is needed for: the
patterns of sources that some document shares with another source. A source that is never shared is an
arc of its own, its flow the smaller of quota and supply, which is a column. Only more than ``MAX_PATTERNS``
patterns of shared sources raise an error. Everything else stays distributed: the cut within a pattern
is found by narrowing a histogram of the hash, so a source with a third of all rows is never sorted
or summed in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null or
missing source lists belong to no source and are never taken; documents of size 0 are taken 0 words;
rows that agree in id, sources and size are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import SPACE_WORDS, unused_name, write_table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
MAX_PATTERNS = 100_000
FILL_ROUNDS = 4
STEP_BITS = 10


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def mix_targets(
    sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST
) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, cut at ``most`` times what there is.

    Sources in code point order, null last, take the weights in turn. What is cut off is shared out
    again among the others until nobody exceeds the limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def min_cost_flow(
    patterns: list[tuple[list[int], int]], quotas: list[int], copies: int = MOST
) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Words taken of each pattern (its sources, its size), and per (pattern, source).

    All cost sits on the arcs that leave the origin (copy r of a pattern's words), so the cheapest
    augmenting path always starts with the lowest copy that still has room: augmenting along shortest
    paths copy by copy is the successive-shortest-path algorithm for these costs.
    """
    n_p = len(patterns)
    sink = n_p + len(quotas)
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        return len(to) - 2

    links = {(p, s): arc(p, n_p + s, copies * size) for p, (own, size) in enumerate(patterns) for s in own}
    for s, q in enumerate(quotas):
        arc(n_p + s, sink, q)
    taken = [0] * n_p
    for _copy in range(copies):
        for p, (_, size) in enumerate(patterns):
            left = size
            while left:
                came, queue = {p: -1}, deque([p])
                while queue and sink not in came:
                    a = queue.popleft()
                    for e in head[a]:
                        if room[e] and to[e] not in came:
                            came[to[e]] = e
                            queue.append(to[e])
                if sink not in came:
                    break
                path, at = [], sink
                while at != p:
                    path.append(came[at])
                    at = to[came[at] ^ 1]
                step = min([left, *(room[e] for e in path)])
                for e in path:
                    room[e] -= step
                    room[e ^ 1] += step
                left -= step
                taken[p] += step
    return taken, {k: room[e ^ 1] for k, e in links.items() if room[e ^ 1]}


@dataclass
class Mix:
    """``units``: id, sources, size, rows (how many rows agree in these), copies; ``sources``: source,
    source_size, target, given (words the flow gives it). Each row of the units has ``size`` words."""

    units: DataFrame
    sources: DataFrame


def mix(
    docs: DataFrame, key: str = "doc_id", sources: str = "sources", size: str = "size",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17, most_patterns: int = MAX_PATTERNS,
) -> Mix:
    """Choose how often each document goes into the mix (0 to ``most`` times)."""
    spark = docs.sparkSession
    units = write_table(
        docs.groupBy(
            F.col(key).alias("id"),
            F.coalesce(F.array_sort(F.array_distinct(F.col(sources))), F.array().cast("array<string>"))
            .alias("sources"),
            F.col(size).cast("long").alias("size"),
        ).agg(F.count(F.lit(1)).alias("rows")).withColumn("h", F.xxhash64(F.lit(seed), "id", "size")),
        "mix-units",
    )
    patterns = units.groupBy("sources").agg(F.sum(F.col("size") * F.col("rows")).alias("n"))
    first = patterns.limit(most_patterns + 1).collect()
    few = len(first) <= most_patterns
    if few:
        total: dict[str | None, int] = {}
        for r in first:
            for s in r.sources:
                total[s] = total.get(s, 0) + r.n
        by_source, plan = _flow_plan(spark, first, mix_targets(total, weights, share, most), total, most)
    else:
        by_source, plan = _wide_plan(write_table(patterns, "mix-patterns"), weights, share, most, most_patterns)
    chosen = _choose(units, plan, few)
    return Mix(chosen.select("id", "sources", "size", "rows", "copies"), by_source)


BY_SOURCE = "source string, source_size long, target double, given long"
PLAN = "sources array<string>, whole long, want long"


def _flow_plan(spark, patterns: list, target: dict, total: dict, most: int) -> tuple[DataFrame, DataFrame]:
    """Words given to each source, and repetitions and rest of each pattern, by the flow."""
    patterns = sorted(patterns, key=lambda r: [(s is None, s or "") for s in r.sources])
    number = {s: i for i, s in enumerate(target)}
    taken, credit = min_cost_flow(
        [([number[s] for s in r.sources], r.n) for r in patterns], [round(t) for t in target.values()], most)
    given = [0] * len(number)
    for (_, s), n in credit.items():
        given[s] += n
    by_source = spark.createDataFrame(
        [(s, total[s], float(target[s]), given[i]) for s, i in number.items()], BY_SOURCE)
    plan = spark.createDataFrame(
        [(r.sources, t // r.n if r.n else 0, t % r.n if r.n else 0) for r, t in zip(patterns, taken)], PLAN)
    return by_source, plan


def spark_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``mix_targets`` for any number of sources: ``totals`` (source, n) with ``target``.

    A source's limit does not change, so the sources that have reached it follow from the words per
    unit of weight alone; each round is one aggregate and two numbers.
    """
    order = F.col("source").asc_nulls_last()
    placed = write_table(
        totals.repartitionByRange(order).sortWithinPartitions(order).select(
            "source", "n", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")),
        "mix-placed")
    # One row per task of the table above.
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "start", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "start")
    place = ((F.col("start") + F.col("at")) % len(weights)).cast("int")
    weighed = write_table(
        placed.join(F.broadcast(starts), "part")
        .select("source", "n", F.element_at(F.array(*map(F.lit, weights)), place + 1).alias("weight")),
        "mix-weights")
    limit = F.col("n") * most
    words, unit, closed = weighed.agg(F.sum("n")).first()[0] or 0, 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > limit
        n_over, used, open_ = weighed.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n_over == closed or not open_:
            return weighed.withColumn(
                "target", F.when(over, limit.cast("double")).otherwise(F.lit(unit) * F.col("weight")))
        closed, unit = n_over, (share * words - used) / open_


def _wide_plan(patterns: DataFrame, weights, share, most, most_patterns) -> tuple[DataFrame, DataFrame]:
    """As ``_flow_plan``, for more patterns than the driver takes."""
    spark = patterns.sparkSession
    each = patterns.select(F.explode("sources").alias("source"), "n", (F.size("sources") > 1).alias("shared"))
    totals = each.groupBy("source").agg(F.sum("n").alias("n"), F.max("shared").alias("shared"))
    totals = write_table(totals, "mix-totals")
    target = spark_targets(totals.select("source", "n"), weights, share, most).select("source", "target")
    sources = totals.withColumnRenamed("source", "own")
    sources = write_table(
        sources.join(target, sources["own"].eqNullSafe(target["source"])).select("source", "n", "shared", "target"),
        "mix-sources")
    alone = sources.filter(~F.col("shared")).withColumn("given", F.bround("target", 0).cast("long"))
    by_source = alone.select("source", F.col("n").alias("source_size"), "target", "given")
    whole = F.when(F.col("n") > 0, F.expr("given div n")).otherwise(0)
    rest = F.when(F.col("n") > 0, F.col("given") % F.col("n")).otherwise(0)
    plan = alone.select(F.array("source").alias("sources"), whole.cast("long").alias("whole"), rest.cast("long").alias("want"))
    # Patterns of a shared source: those of several sources, and that source's own.
    joint = sources.filter("shared").limit(most_patterns + 1).collect()
    own = sources.filter("shared").select(F.array("source").alias("sources"))
    several = patterns.filter(F.size("sources") > 1)
    asked = several.unionByName(patterns.join(own, "sources", "left_semi")).limit(most_patterns + 1).collect()
    if max(len(joint), len(asked)) > most_patterns:
        raise ValueError(f"more than {most_patterns} distinct sets of shared sources")
    joint.sort(key=lambda r: (r.source is None, r.source or ""))
    given, flow = _flow_plan(
        spark, asked, {r.source: r.target for r in joint}, {r.source: r.n for r in joint}, most)
    return by_source.unionByName(given), plan.unionByName(flow)


def _choose(units: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Units with ``copies``: the whole repetitions, and one more for those within ``want`` words.

    ``few``: the plan has at most ``MAX_PATTERNS`` rows and may be broadcast.
    """
    small = F.broadcast if few else lambda df: df
    weight = F.col("size") * F.col("rows")
    steps = [F.shiftrightunsigned("h", 64 - STEP_BITS * (i + 1)).bitwiseAND((1 << STEP_BITS) - 1)
             for i in range(2)]
    cut = plan.withColumn("low", F.lit(0).cast("long"))
    keys: list[str] = []
    for i, step in enumerate(steps):
        # Words per slice of the hash within the slice that the step before found to hold the cut.
        b = f"b{i}"
        inside = units if not keys else units.withColumn("b0", steps[0])
        inside = inside.join(small(cut), ["sources", *keys])  # a row per pattern
        slices = inside.withColumn(b, step).groupBy("sources", "whole", "want", "low", *keys, b).agg(
            F.sum(weight).alias("n"))
        upto = Window.partitionBy("sources").orderBy(b)
        before = F.col("low") + F.sum("n").over(upto) - F.col("n")
        cut = slices.withColumn("low", before).filter(
            (F.col("low") <= F.col("want")) & (F.col("want") < F.col("low") + F.col("n"))
        ).drop("n")
        keys.append(b)
    cut = write_table(cut, "mix-cut").select("sources", F.col("low"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))
    placed = units.join(small(plan), "sources", "left").join(small(cut), "sources", "left")
    placed = placed.withColumn("place", F.when(F.col("c0").isNull(), F.lit(1)).otherwise(
        F.coalesce(F.nullif(F.signum(steps[0] - F.col("c0")), F.lit(0.0)), F.signum(steps[1] - F.col("c1")))
    ))
    # Rows of the one slice that holds the cut are added up one by one; all others are decided.
    at_cut = placed.filter("place = 0")
    line = Window.partitionBy("sources").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = at_cut.withColumn("extra", (F.col("low") + F.sum(weight).over(line) <= F.col("want")).cast("long"))
    rest = placed.filter("place <> 0").withColumn("extra", (F.col("place") < 0).cast("long"))
    marked = write_table(
        rest.unionByName(at_cut).select(*units.columns, "whole", "want", "extra"), "mix-marked"
    )
    for _ in range(FILL_ROUNDS):
        gap = marked.groupBy("sources").agg(
            F.max("want").alias("want"), F.sum(F.col("extra") * weight).alias("got")
        ).select("sources", (F.col("want") - F.col("got")).alias("gap"))
        # The one document whose change, in or out, leaves the smallest gap.
        left = F.abs(F.col("gap") - F.when(F.col("extra") == 0, weight).otherwise(-weight))
        pick = (
            marked.join(small(gap), "sources").filter(left < F.abs("gap"))
            .groupBy("sources").agg(F.min(F.struct(left.alias("left"), "h", "id", "size")).alias("p"))
            .select("sources", F.col("p.h").alias("ph"), F.col("p.id").alias("pid"), F.col("p.size").alias("ps"))
        )
        marked = write_table(
            marked.join(small(pick), "sources", "left")
            .withColumn("extra", F.when(
                (F.col("h") == F.col("ph")) & F.col("id").eqNullSafe(F.col("pid")) & (F.col("size") == F.col("ps")),
                1 - F.col("extra")).otherwise(F.col("extra")))
            .drop("ph", "pid", "ps"),
            "mix-filled",
        )
    copies = F.when(F.size("sources") == 0, 0).otherwise(F.coalesce("whole", F.lit(0)) + F.col("extra"))
    return marked.withColumn("copies", copies)


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it (0 times: gone)."""
    by, size, copies = (unused_name(docs, n) for n in ("sources", "mix_size", "mix_copies"))
    sized = docs.withColumns({by: F.array(F.col(source).cast("string")), size: text_size(F.col(text))})
    units = mix(sized.select(key, by, size), key, by, size, **options).units
    wanted = units.filter("copies > 0").select(
        F.col("id").alias("u_id"), F.col("sources").alias("u_sources"), F.col("size").alias("u_size"),
        F.col("copies").alias("u_copies"),
    )
    match = (
        sized[key].eqNullSafe(wanted["u_id"]) & sized[by].eqNullSafe(wanted["u_sources"])
        & (sized[size] == wanted["u_size"])
    )
    return (
        sized.join(wanted, match)
        .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), wanted["u_copies"])))
        .select(*(docs[c] for c in docs.columns))
    )
