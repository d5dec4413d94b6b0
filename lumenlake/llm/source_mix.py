"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenlake.llm.common import BLANKS, stored

# Weights by rank of the source name, repeating.
WEIGHTS = (5, 2, 1)
# No document is taken more often than this; a source's target stops there too.
MOST_PASSES = 3
SEED = 20240501
# The seeded order is a number of so many bits. It is summed in 2^SLICE_BITS slices per pattern, then the slice in
# which the rest ends in as many again; only rows that share all LEVELS slices are sorted, one in 2^24.
PLACE_BITS, SLICE_BITS, LEVELS = 60, 8, 3


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int = 0


@dataclass
class _Network:
    """Min-cost flow by successive cheapest paths; nodes are patterns and sources only."""

    arcs: dict[int, list[_Arc]] = field(default_factory=dict)

    def add(self, a: int, b: int, room: int, cost: int) -> _Arc:
        forth, back = self.arcs.setdefault(a, []), self.arcs.setdefault(b, [])
        forth.append(_Arc(b, room, cost, len(back)))
        back.append(_Arc(a, 0, -cost, len(forth) - 1))
        return forth[-1]

    def push(self, source: int, sink: int) -> None:
        while True:
            cost, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for arc in self.arcs[a]:
                    if arc.room > 0 and cost[a] + arc.cost < cost.get(arc.to, 1 << 60):
                        cost[arc.to], via[arc.to] = cost[a] + arc.cost, (a, arc)
                        if arc.to not in queued:
                            queued.add(arc.to)
                            queue.append(arc.to)
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                at, arc = via[at]
                path.append(arc)
            room = min(arc.room for arc in path)
            for arc in path:
                arc.room -= room
                self.arcs[arc.to][arc.back].room += room


def targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float) -> dict[str | None, float]:
    """Shares of `total` by weight; what exceeds `MOST_PASSES` times a source's size is shared anew by weight."""
    fixed: dict[str | None, float] = {}
    while True:
        left = [s for s in sizes if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in left)
        shares = {s: rest * weights[s] / weight if weight else 0.0 for s in left}
        over = [s for s in left if shares[s] > MOST_PASSES * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: float(MOST_PASSES * sizes[s]) for s in over}


def route(patterns: Mapping[tuple, int], quotas: Mapping[str | None, float]) -> dict[tuple, int]:
    """Words to take of each pattern, so that sources reach their quotas with the fewest repetitions.

    A pass over a pattern offers its size again and costs one more each time.
    """
    net, names = _Network(), list(quotas)
    start, end, first = 0, 1, 2
    source_node = {s: first + i for i, s in enumerate(names)}
    for s in names:
        net.add(source_node[s], end, round(quotas[s]), 0)
    offers = {}
    for i, (members, size) in enumerate(patterns.items()):
        node = first + len(names) + i
        offers[members] = [net.add(start, node, size, repeat) for repeat in range(MOST_PASSES)]
        for s in members:
            net.add(node, source_node[s], MOST_PASSES * size, 0)
    net.arcs.setdefault(start, [])
    net.push(start, end)
    return {members: sum(patterns[members] - arc.room for arc in arcs) for members, arcs in offers.items()}


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def _slice(level: int) -> Column:
    """Number of a row's slice when the seeded order is cut `level` times."""
    return F.shiftright("place", PLACE_BITS - level * SLICE_BITS)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None,
    weights: Mapping[str | None, float] | Sequence[float] = WEIGHTS, seed: int = SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), then columns named in `carry`: how many words of each document a weighted mix takes.

    `sources` is the array of sources that a document belongs to (default: its
    `source` column alone); `source_size` and `target` are those of the first of
    them. A sequence of weights goes round over the sources by code point, null last.
    Targets share the size of all documents. Documents are summed by membership
    pattern; the flow over patterns and sources, whose number is bounded by the
    source names, decides how often each pattern is passed. Whole passes take every
    document; the rest takes documents in seeded order up to the nearest one, so
    `taken` is a multiple of `size`, at most `MOST_PASSES` times. Reruns agree: the order
    hangs on id, text and seed. A null text has size 0; null ids and repeated rows
    are documents of their own; a null list of sources is the source null; other
    columns are ignored; an empty table gives an empty result.
    """
    member = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array(F.lit(None).cast("string")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), text)), 1, 15), 16, 10)
    sized = stored(docs.select(
        *carry, F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("size"), member.alias("members"),
        order.cast("long").alias("place"),
    ), [])
    rows = sized.groupBy("members").agg(F.sum("size").alias("size")).collect()
    patterns = {tuple(dict.fromkeys(r["members"])): 0 for r in rows}
    sizes: dict[str | None, int] = {}
    for r in rows:
        members = tuple(dict.fromkeys(r["members"]))
        patterns[members] += r["size"]
        for s in members:
            sizes[s] = sizes.get(s, 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    by_name = weights if isinstance(weights, Mapping) else {s: weights[i % len(weights)] for i, s in enumerate(names)}
    quotas = targets(sizes, by_name, sum(patterns.values()))
    taken = route(patterns, quotas)
    plan = []
    for r in rows:
        members = tuple(dict.fromkeys(r["members"]))
        size = patterns[members]
        passes, rest = divmod(taken[members], size) if size else (0, 0)
        first = members[0] if members else None
        plan.append((list(r["members"]), sizes.get(first, 0), round(quotas.get(first, 0.0), 6), passes, rest, "\0".join(
            "\1" if s is None else s for s in members)))
    schema = "members array<string>, source_size long, target double, passes long, rest long, pattern string"
    # One row per membership pattern, all from source names.
    shares = F.broadcast(docs.sparkSession.createDataFrame(plan, T._parse_datatype_string(schema)))
    known = sized.join(shares, sized["members"].eqNullSafe(shares["members"])).drop("members")
    # The slice in which the rest ends, level by level: lower ones are taken whole, higher ones not.
    edge = None
    for level in range(1, LEVELS + 1):
        part = known.where("rest > 0").select("pattern", "rest", "size", _slice(level).alias("slice"))
        if edge is None:
            part = part.withColumn("before", F.lit(0).cast("long"))
        else:
            part = part.join(edge, "pattern").where(F.shiftright("slice", SLICE_BITS) == F.col("last"))
        sums = part.groupBy("pattern", "slice", "rest", "before").agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("slice"))
        # One row per pattern.
        edge = F.broadcast(
            sums.withColumn("upto", upto).where("upto > rest").groupBy("pattern")
            .agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
            .select("pattern", F.col("edge.slice").alias("last"), F.col("edge.before").alias("before")))
    placed = known.withColumn("slice", _slice(LEVELS)).join(edge, "pattern", "left")
    inside = placed.where(F.col("slice") == F.col("last"))
    by_place = Window.partitionBy("pattern").orderBy("place", F.col("doc_id").asc_nulls_last())
    before = F.col("before") + F.sum("size").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    inside = inside.withColumn("more", (2 * before + F.col("size") <= 2 * F.col("rest")).cast("long"))
    outside = placed.where(F.col("last").isNull() | (F.col("slice") != F.col("last"))).withColumn(
        "more", F.coalesce(F.col("slice") < F.col("last"), F.lit(False)).cast("long"))
    return outside.unionByName(inside).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"), *carry)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as often as the mix takes them: untaken ones go, repeated ones repeat."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col), F.col(text_col), F.col("source"))
    mixed = mix(whole, id_col, text_col, carry=["_row"]).where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.select("_row", F.explode(times)).select("_row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, {MOST_PASSES} * source_size / weight AS ratio,
         sum({MOST_PASSES} * source_size) OVER w - {MOST_PASSES} * source_size AS capped_before,
         sum(weight) OVER () - sum(weight) OVER w + weight AS free_before, sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY {MOST_PASSES} * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max((total - capped_before) / free_before) AS share FROM o),
t AS (
  SELECT source, source_size, CASE WHEN ratio < share THEN {MOST_PASSES} * source_size ELSE share * weight END AS target
  FROM o CROSS JOIN level),
c AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE size * (quota // source_size + CASE WHEN quota % source_size > 0 AND 2 * before + size <= 2 * (quota % source_size) THEN 1 ELSE 0 END)
            END AS BIGINT) AS taken
FROM c
"""
