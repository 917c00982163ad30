"""Exact nearest neighbours on a grid index, whatever the size of a group.

Rows meet only inside their group (`keys`). Equal vectors are one point with a count. A grid over the
features of the widest spread cuts points and queries into cells, and every cell keeps the bounding box
of its members over all features. Rings are widened on cells, not rows: a query cell meets the point
cells of its own and the adjoining cells of the grid, at a width that doubles each round. The largest
distance between two boxes bounds what any query of the cell can find; once that is within the ring's
width no point outside can be nearer, and only the point cells whose least distance does not exceed the
bound are kept. So the search is exact, and rounds are about as many as the doublings from the width
to the spread of a sparse group.

Kept pairs of cells become jobs of at most `QUERIES` x `POINTS` rows: hot cells are split by salt on both
sides, so no task compares more than a job at a time. The grid is the one of least estimated work, from
approximate counts of occupied cells; a grid of no feature, one cell for each group, is among them, and
is taken at once where all pairs of the groups are fewer than `PAIRS_WORTH_A_GRID`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import finite
from policylake.sources.sinks import staged

QUERIES, POINTS = 2048, 1024
PAIRS_WORTH_A_GRID = 2_000_000_000
COMPARISONS = 20_000_000  # of one task
_DIMENSIONS = (2, 3, 4, 6)
_WIDTHS = tuple(2.0**-j for j in range(-1, 7))


def _whole(features: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [finite(f) for f in features])


def _cell(feature: str, width: float) -> Column:
    return F.floor(F.col(feature) / width).cast("long")


def choose_grid(points: DataFrame, queries: DataFrame, keys: list[str], features: list[str]) -> tuple[list[str], float, int]:
    """Grid features, cell width, and the number of doublings after which a ring holds everything."""
    sides = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("p")).join(queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("q")), keys)
    pairs = sides.agg(F.sum(F.col("p").cast("double") * F.col("q"))).first()[0] or 0.0
    if pairs <= PAIRS_WORTH_A_GRID:
        return [], 1.0, 0
    spread = points.agg(*[F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f) for f in features]).first()
    by_spread = sorted(features, key=lambda f: (-spread[f], f))
    options = [(g, w) for g in _DIMENSIONS if g <= len(features) for w in _WIDTHS] or [(len(features), w) for w in _WIDTHS]

    def counted(rows: DataFrame):
        cells = [F.approx_count_distinct(F.xxhash64(*keys, *[_cell(f, w) for f in by_spread[:g]]), 0.1).alias(f"c{i}") for i, (g, w) in enumerate(options)]
        ends = [fn(f).alias(f"{end}_{f}") for f in features for end, fn in (("low", F.min), ("high", F.max))]
        return rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("groups"), *cells, *ends).first()

    p, q = counted(points), counted(queries)
    groups = max(p["groups"], 1)

    def work(i: int) -> float:
        near = min(3 ** options[i][0], p[f"c{i}"] / groups)
        rows = near * p["n"] / max(p[f"c{i}"], 1)
        return 10.0 * q[f"c{i}"] * 3 ** options[i][0] + 60.0 * q[f"c{i}"] * near + q["n"] * (rows + 8.0 * near)

    best = min(range(len(options)), key=work)
    if pairs <= work(best):
        return [], 1.0, 0
    g, width = options[best]
    dims = by_spread[:g]
    extent = max((max(p[f"high_{f}"], q[f"high_{f}"]) - min(p[f"low_{f}"], q[f"low_{f}"]) for f in dims), default=0.0) if p["n"] and q["n"] else 0.0
    return dims, width, max(0, math.ceil(math.log2(max(extent / width, 1.0)))) + 1


def _boxes(rows: DataFrame, keys: list[str], features: list[str], side: str) -> DataFrame:
    box = [fn(f).alias(f"{side}{end}_{f}") for f in features for end, fn in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}n"), *box)


def _square(x: Column) -> Column:
    return x * x


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def distinct_distances(queries: DataFrame, points: DataFrame, keys: list[str], features: list[str], name: str) -> DataFrame:
    """Distance of every distinct query vector to the nearest point of its group other than itself.

    `points` has each vector of a group once with its count `n`; `queries` has vectors with a flag `own`:
    such a query is one of its points, so an equal vector is a neighbour only from the second copy on. Null
    where the group has no other point.
    """
    same = points.select(*keys, *features, F.col("n").alias("__equal"))
    asked = staged(queries.where(_whole(features)).select(*keys, *features, "own").distinct().join(same, [*keys, *features], "left"), "neighbours")
    copies = F.coalesce(F.col("__equal"), F.lit(0))
    met = copies > F.when(F.col("own"), F.lit(1)).otherwise(F.lit(0))
    zero = asked.where(met).select(*keys, *features, "own", F.lit(0.0).alias(name))
    left = asked.where(~met).drop("__equal").join(points.select(*keys).distinct(), keys, "left_semi")
    dims, width, last = choose_grid(points, left, keys, features)
    cell = [f"__c{i}" for i in range(len(dims))]
    on_grid = {c: _cell(f, width) for c, f in zip(cell, dims, strict=True)}
    points, left = points.withColumns(on_grid), left.withColumns(on_grid)
    theirs = [f"__p{i}" for i in range(len(dims))]
    q_cells = staged(_boxes(left, [*keys, "own", *cell], features, "q"), "neighbours")
    p_cells = staged(_boxes(points, [*keys, *cell], features, "p").withColumnsRenamed(dict(zip(cell, theirs, strict=True))), "neighbours")

    least = _total([_square(F.greatest(F.lit(0.0), F.col(f"plow_{f}") - F.col(f"qhigh_{f}"), F.col(f"qlow_{f}") - F.col(f"phigh_{f}"))) for f in features])
    most = _total([_square(F.greatest(F.col(f"phigh_{f}") - F.col(f"qlow_{f}"), F.col(f"qhigh_{f}") - F.col(f"plow_{f}"))) for f in features])
    itself = reduce(lambda a, b: a & b, [F.col(c) == F.col(t) for c, t in zip(cell, theirs, strict=True)], F.col("own") & (F.col("pn") == 1))
    query_key = [*keys, "own", *cell]
    pairs, waiting = (None, q_cells) if dims else (q_cells.join(p_cells, keys).select(*query_key, "qn", "pn"), None)
    for level in range(last + 1 if dims else 0):
        near = waiting
        for i, c in enumerate(cell):
            near = near.withColumn(f"__n{i}", F.explode(F.array(*[F.shiftright(c, level) + o for o in (-1, 0, 1)])))
        coarse = p_cells.withColumns({f"__n{i}": F.shiftright(t, level) for i, t in enumerate(theirs)})
        met_cells = near.join(coarse, [*keys, *[f"__n{i}" for i in range(len(dims))]])
        found = staged(met_cells.select(*query_key, *theirs, "qn", "pn", least.alias("least"), F.when(~itself, most).alias("most")), "neighbours")
        bound = found.groupBy(*query_key).agg(F.min("most").alias("bound"))
        reach = (width * 2.0**level) * (1 - 1e-9)
        settled = staged(bound if level == last else bound.where(F.col("bound") <= reach * reach), "neighbours")
        kept = found.join(settled, query_key).where(F.col("least") <= F.col("bound") * (1 + 1e-9)).select(*query_key, *theirs, "qn", "pn")
        pairs = kept if pairs is None else pairs.unionByName(kept)
        if level < last:
            waiting = staged(waiting.join(settled, query_key, "left_anti"), "neighbours")
            if not waiting.limit(1).count():
                break

    def parts(size: str, most: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / most).cast("long")))

    jobs = pairs.withColumn("__qs", parts("qn", QUERIES)).withColumn("__ps", parts("pn", POINTS))
    jobs = staged(jobs.withColumn("job", F.monotonically_increasing_id()), "neighbours")
    work = jobs.agg(F.sum(F.least("qn", F.lit(QUERIES)).cast("double") * F.least("pn", F.lit(POINTS)))).first()[0] or 0.0
    # shuffled bytes say little about the comparisons behind them, so the number of tasks is set here
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(work / COMPARISONS))

    def salted(rows: DataFrame, cells: DataFrame, key: list[str], size: str, most: int, salt: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*features), F.floor((F.col(size) - 1) / most).cast("long") + 1)
        return rows.join(cells.select(*key, size), key).withColumn(salt, spread).drop(size)

    p_key = [*keys, *theirs]
    asking = salted(left, q_cells, query_key, "qn", QUERIES, "__qs").join(jobs.select(*query_key, "__qs", "job"), [*query_key, "__qs"])
    offered = salted(points.withColumnsRenamed(dict(zip(cell, theirs, strict=True))), p_cells, p_key, "pn", POINTS, "__ps")
    offered = offered.join(jobs.select(*p_key, "__ps", "job"), [*p_key, "__ps"]).select("job", *[F.col(f).alias(f"__r_{f}") for f in features])
    differ = reduce(lambda a, b: a | b, [F.col(f) != F.col(f"__r_{f}") for f in features])
    apart = _total([_square(F.col(f) - F.col(f"__r_{f}")) for f in features])
    hits = asking.repartition(tasks, "job").join(offered.repartition(tasks, "job"), "job").where(differ).groupBy(*keys, *features, "own").agg(F.sqrt(F.min(apart)).alias(name))
    return zero.unionByName(hits)


def point_counts(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Each group's distinct vectors and how often they come; rows with a missing or infinite feature are no points."""
    return staged(rows.where(_whole(features)).groupBy(*keys, *features).agg(F.count(F.lit(1)).alias("n")), "neighbours")
