"""N-gram Jaccard join by vertical partitioning.

The global n-gram order (rare before frequent, then by hash) is cut into fragments. Candidates
come from the rarest part of each set, its prefix: of n n-grams the first n - ceil(share * n) + s,
of which a linked pair has s in common. The overlap of a candidate pair is counted fragment by
fragment and summed per pair.

Equal sets are one node (64-bit sum of mixed n-gram hashes: two different sets are taken for one
with odds below n^2 / 2^65), so copies never meet as pairs. In a prefix bucket every node is first
compared with two nodes only: the one in whose order the n-gram stands first, which has the fewest
n-grams of its own and so is nearest to the others, and the one of the highest hash. Then
connected nodes count as one, and just those pairs of a bucket that are still in different
components are compared. So no link between components is lost.

Before any fragment travels, a pair has to pass its signatures: bit i of a set's signature is the
parity of its n-grams with hash i, so two sets differ in at least as many n-grams as their signatures
in bits. Nearly all pairs that pass are links.

All links of a set lie in its component, so they are counted there at last, all pairs of it: a
component is dealt into classes of size, of which only equal and next ones can be linked, and these
into blocks of at most about BLOCK sets and GRAMS n-grams; a task compares two blocks and passes on
counts, not pairs. Components of two sets have one link.

The frequent n-grams are found by counting in every task and adding up what occurs in several
texts of a task; at most `hot` of them are broadcast. They only order n-grams; any order gives the
same links.

A null text or one without words has an empty set, links with nothing and is its own component.
Repeated rows are copies. A null key stays null as component unless a copy has a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.components import components
from policylake.llm.staging import likely, maybe, small_batches, staged

SEEN = 400_000
#: N-grams that are broadcast as frequent.
HOT = 1_048_576
#: N-grams that the prefixes of a linked pair share at least (fewer where the sets are smaller).
SHARED = 4
#: Bits of a signature: about 2 to 4 for each n-gram, within these bounds.
LEAST, MOST = 64, 1 << 17
#: Sets and n-grams of a block.
BLOCK, GRAMS = 1024, 2_000_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, n-grams, their row, set sizes, nodes) of runs of rows; n-grams ascend in a row."""
    for row, end, data, at in bytewise.chunks(column):
        start, stop, of = bytewise.words(data, at)
        grams, of = bytewise.distinct(*bytewise.shingles(bytewise.hashes(bytewise.LOWER[data], start, stop), of, k))
        rows = end - row
        size = np.bincount(of, minlength=rows)
        node = np.zeros(rows, np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            node[full] = bytewise.mix(np.add.reduceat(bytewise.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), np.r_[0, np.cumsum(size[full])[:-1]]) + size[full].astype(np.uint64))
        yield row, end, grams, of, size, node


def _signatures(grams: np.ndarray, of: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parities of each row's n-grams by their low bits, as bytes; none for an empty set."""
    width = np.where(size > 0, np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), LEAST, MOST), 0)
    edge = np.r_[0, np.cumsum(width)]
    odd = np.bincount(edge[of] + (grams & (width[of] - 1).astype(np.uint64)).astype(np.int64), minlength=edge[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((edge // 8).astype(np.int32)), pa.py_buffer(data)])


def _differing(x: bytes, y: bytes) -> int:
    """N-grams that two sets differ in at least; the wider signature is folded."""
    one, two, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    if len(x) < len(y):
        one, two, bits = two, one, 8 * len(y)
    while bits > 8 * min(len(x), len(y)):
        bits //= 2
        one = (one >> bits) ^ (one & ((1 << bits) - 1))
    return (one ^ two).bit_count()


def _nodes(documents: DataFrame, k: int, key: str) -> DataFrame:
    """(key, n, node, signature) of every row."""
    slim = documents.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for row, end, grams, of, size, node in _sets(batch.column("text"), k):
                columns = [keys.slice(row, end - row), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64)), _signatures(grams, of, size)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "node", "signature"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, n long, node long, signature binary")


class _Fresh:
    """Nodes that a task has not met lately."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, node: np.ndarray, size: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(node), bool)
        for i, (x, n) in enumerate(zip(node.tolist(), size.tolist(), strict=True)):
            if n and x not in self.seen:
                self.seen.add(x)
                keep[i] = True
        if len(self.seen) > SEEN:
            self.seen.clear()
        return keep


def _frequent(documents: DataFrame, k: int, hot: int) -> np.ndarray:
    """N-grams that occur in many texts of some task, sorted; at most `hot`."""
    slim = documents.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, kept, total = _Fresh(), [], np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold(least: int) -> tuple[np.ndarray, np.ndarray]:
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            grams, count = grams[count >= least], count[count >= least]
            both, where = np.unique(np.r_[kept, grams], return_inverse=True)
            return both, np.bincount(where, weights=np.r_[total, count], minlength=len(both)).astype(np.int64)

        for batch in batches:
            for _, _, grams, of, size, node in _sets(batch.column("text"), k):
                held.append(grams[fresh(node, size)[of]])
                if sum(map(len, held)) > 2_000_000:
                    kept, total = fold(2)
                    held = []
        if held:
            kept, total = fold(2)
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(total)], ["g", "n"])

    top = slim.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(hot)
    return np.sort(top.select("g").toArrow().column("g").to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(documents: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(g, node, n, place) for the rarest n-grams of each set: n less the share a pair has, plus SHARED."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    slim = documents.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, hot = _Fresh(), shared.value
        for batch in batches:
            for _, _, grams, of, size, node in _sets(batch.column("text"), k):
                keep = fresh(node, size)
                grams, of = grams[keep[of]], of[keep[of]]
                late = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams if len(hot) else np.zeros(len(grams), bool)
                order = np.lexsort((late, of))
                grams, of = grams[order], of[order]
                kept = np.where(keep, size, 0)
                place = np.arange(len(grams)) - np.repeat(np.r_[0, np.cumsum(kept)[:-1]], kept)
                n = size[of]
                least = (percent * n + 99) // 100
                take = place < n - least + np.minimum(SHARED, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[take].view(np.int64)), pa.array(node[of[take]].view(np.int64)), pa.array(n[take].astype(np.int32)), pa.array(place[take].astype(np.int32))],
                    ["g", "node", "n", "place"],
                )

    return slim.mapInArrow(run, "g long, node long, n int, place int")


def _fragments(documents: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(node, part, grams) of the sets whose node may be wanted: a slice of the order in each row."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)
    slim = documents.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, bits = _Fresh(), shared.value
        for batch in batches:
            for _, _, grams, of, size, node in _sets(batch.column("text"), k):
                keep = fresh(node, size) & maybe(bits, node)
                grams, of = grams[keep[of]], of[keep[of]]
                if not len(grams):
                    continue
                part = (grams >> np.uint64(60)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (part[1:] != part[:-1])])
                values = pa.ListArray.from_arrays(pa.array(np.r_[first, len(grams)].astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[of[first]].view(np.int64)), pa.array(part[first].astype(np.int32)), values], ["node", "part", "grams"])

    return slim.mapInArrow(run, "node long, part int, grams array<long>").dropDuplicates(["node", "part"])


def _only(rows: DataFrame, column: str, keys: DataFrame, shift: int = 0) -> DataFrame:
    """The rows whose `column`, a long, may be among `keys`; `shift` leaves out high bits that are not spread."""
    size = int(np.clip((16 * keys.count()).bit_length(), 20, 27))
    bits = rows.sparkSession.sparkContext.broadcast(likely(keys.select(F.shiftleft(column, shift).alias(column)), column, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(bits.value, batch.column(column).to_numpy().view(np.uint64) << np.uint64(shift), size)))

    return rows.mapInArrow(run, rows.schema)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) whose signatures leave the share of the union possible."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    signed = _only(nodes.where("n > 0").select("node", "signature"), "node", ends).dropDuplicates(["node"])
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b").select("a", "na", "b", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            apart = np.array([_differing(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            most = (total - apart) // 2
            yield batch.select(["a", "na", "b", "nb"]).filter(pa.array(100 * most >= percent * (total - most)))

    return both.mapInArrow(run, both.select("a", "na", "b", "nb").schema)


def _linked(fragments: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) whose summed fragment overlaps reach the share of the union."""
    left = fragments.select(F.col("node").alias("a"), "part", F.col("grams").alias("left"))
    right = fragments.select(F.col("node").alias("b"), "part", F.col("grams").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("overlap"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return staged(whole.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links")


def _possible(x: str, y: str, percent: int):
    """What two sizes and the places of one of the first SHARED common n-grams leave possible.

    Common n-grams before this one are among those of both sides that are in a bucket (s).
    """
    earlier = F.least(F.col(f"s{x}"), F.col(f"s{y}"), F.lit(SHARED - 1))
    need = (percent * (F.col(f"n{x}") + F.col(f"n{y}"))) / (100 + percent) - earlier
    return F.least(F.col(f"n{x}") - F.col(f"p{x}"), F.col(f"n{y}") - F.col(f"p{y}")) >= need - 1e-6


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) that occur with as many n-grams as a link needs."""
    least = F.ceil(F.least("na", "nb") * percent / 100)
    return pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("common")).where(F.col("common") >= F.least(F.lit(SHARED), least)).drop("common")


def _overlaps(gram: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Common n-grams of each row of side 0 with each of side 1, from (n-gram, row, side) of all sets.

    An n-gram that many sets have goes through a product of matrices, one that few have through its pairs.
    """
    order = np.lexsort((side, gram))
    gram, row, side = gram[order], row[order], side[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    have = np.diff(np.r_[first, len(gram)])
    right = np.add.reduceat(side, first)
    left = have - right
    out = np.zeros(rows * columns, np.int64)
    often = left * right * 128 > rows * columns
    few = np.flatnonzero((left > 0) & (right > 0) & ~often)
    for part in np.split(few, np.searchsorted(np.cumsum(left[few] * right[few]), np.arange(2_000_000, int((left[few] * right[few]).sum()), 2_000_000))):
        pairs = left[part] * right[part]
        of = np.repeat(np.arange(len(part)), pairs)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x, y = first[part][of] + nth // right[part][of], first[part][of] + left[part][of] + nth % right[part][of]
        np.add.at(out, row[x] * columns + row[y], 1)
    out = out.reshape(rows, columns)
    kind = np.repeat(np.cumsum(often) - 1, have)
    many = np.repeat(often, have)
    kind, row, side = kind[many], row[many], side[many]
    for low in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(kind, [low, low + 2048])
        at, one, two = slice(a, b), np.zeros((rows, 2048), np.float32), np.zeros((columns, 2048), np.float32)
        for matrix, which in ((one, 0), (two, 1)):
            mine = side[at] == which
            matrix[row[at][mine], kind[at][mine] - low] = 1
        out += (one @ two.T).astype(np.int64)
    return out


def _cell(percent: int):
    """Links of each node in a cell: with the nodes of the other block, or of its own in a cell of one."""

    def run(cell: pa.Table) -> pa.Table:
        side, node = cell.column("side").to_numpy().astype(np.int64), cell.column("node").to_numpy()
        lists = cell.column("grams").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        gram = lists.flatten().to_numpy().view(np.uint64)
        ends, counts, place = [], [], np.zeros(len(node), np.int64)
        for which in (0, 1):
            own, at = np.unique(node[side == which], return_inverse=True)
            place[side == which] = at
            ends.append(own)
            counts.append(np.bincount(at, weights=size[side == which], minlength=len(own)).astype(np.int64))
        row, of = np.repeat(place, size), np.repeat(side, size)
        step, x, y = (cell.column(c)[0].as_py() for c in ("step", "x", "y"))
        alone = step == 0 and x == y
        if alone:
            ends[1], counts[1] = ends[0], counts[0]
            gram, row, of = np.r_[gram, gram], np.r_[row, row], np.r_[of, of + 1]
        if not (len(ends[0]) and len(ends[1])):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        common = _overlaps(gram, row, of, len(ends[0]), len(ends[1]))
        linked = 100 * common >= percent * (counts[0][:, None] + counts[1][None, :] - common)
        if alone:
            np.fill_diagonal(linked, False)
            return pa.table({"node": pa.array(ends[0]), "links": pa.array(linked.sum(1).astype(np.int64))})
        return pa.table({"node": pa.array(np.concatenate(ends)), "links": pa.array(np.r_[linked.sum(1), linked.sum(0)].astype(np.int64))})

    return run


def _counted(fragments: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(node, n_links) of every node of `near` (node, comp): its links within its component, all pairs compared."""
    sets = fragments.groupBy("node").agg(F.sum(F.size("grams")).alias("n"))
    member = staged(near.join(sets, "node"), "member")
    whole = member.groupBy("comp").agg(F.count("*").alias("all"), F.sum("n").alias("grams"))
    two = near.join(whole.where("all = 2").select("comp"), "comp").select("node", F.lit(1).cast("long").alias("n_links"))
    # a class is a little wider than the largest ratio of linked sizes
    width = float(np.log(100 / percent)) * 1.0001 + 1e-6
    small = (F.col("all") <= BLOCK) & (F.col("grams") <= GRAMS)
    sized = member.join(whole.where("all > 2"), "comp").select("comp", "node", "n", F.when(small, 0).otherwise(F.floor(F.log("n") / width)).cast("long").alias("q"))
    dealt = staged(sized.groupBy("comp", "q").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / GRAMS)).cast("long").alias("blocks")), "blocks")
    beside = [dealt.select("comp", (F.col("q") + step).alias("q"), F.col("blocks").alias(name)) for step, name in ((-1, "up"), (1, "down"))]
    placed = sized.join(dealt, ["comp", "q"]).join(beside[0], ["comp", "q"], "left").join(beside[1], ["comp", "q"], "left")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = F.expr(
        "concat(transform(sequence(0L, blocks - 1), j -> struct(q as q, 0 as step, least(i, j) as x, greatest(i, j) as y, cast(i > j as int) as side)),"
        " if(up is null, array(), transform(sequence(0L, coalesce(up, 1L) - 1), j -> struct(q as q, 1 as step, i as x, j as y, 0 as side))),"
        " if(down is null, array(), transform(sequence(0L, coalesce(down, 1L) - 1), j -> struct(q - 1 as q, 1 as step, j as x, i as y, 1 as side))))"
    )
    rows = placed.select("comp", "node", F.explode(cells).alias("c")).select("comp", "node", "c.*").join(fragments.select("node", "grams"), "node")
    own = rows.groupBy("comp", "q", "step", "x", "y").applyInArrow(_cell(percent), "node long, links long")
    return two.union(own.groupBy("node").agg(F.sum("links").alias("n_links")))


def _groups(documents: DataFrame, k: int, percent: int, hot: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n, node, signature) of every row, (node, comp) of every linked node, and the fragments of these."""
    small_batches(documents.sparkSession)
    nodes = staged(_nodes(documents, k, key), "nodes")
    prefix = staged(_prefixes(documents, k, percent, _frequent(documents, k, hot)), "prefix")
    # longs only, so that the partial sums stay small; most n-grams occur in one set
    ends = (F.min("node").alias("least"), F.max("node").alias("high"), F.min_by("node", "place").alias("low"))
    bucket = staged(prefix.groupBy("g").agg(*ends).where("least <> high").select("g", "low", "high"), "bucket")
    # how many of a node's earlier n-grams can be shared at all
    before = F.dense_rank().over(Window.partitionBy("node").orderBy("place")) - 1
    member = staged(_only(prefix, "g", bucket, 24).join(bucket, "g").withColumn("seen", before), "member")

    def side(c: str) -> DataFrame:
        centre = member.where(F.col("node") == F.col(c)).groupBy("g").agg(F.min("node").alias("b"), F.min("n").alias("nb"), F.min("place").alias("pb"), F.min("seen").alias("sb"))
        pair = member.select("g", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("seen").alias("sa")).join(centre, "g")
        return pair.where((F.col("a") != F.col("b")) & _possible("a", "b", percent))

    def upright(pairs: DataFrame) -> DataFrame:
        swap = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return pairs.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        close = staged(_near(staged(_enough(pairs, percent), "pairs"), nodes, percent), "near")
        ends = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        fragments = staged(_fragments(documents, k, likely(ends, "node")), "fragments")
        return _linked(fragments, close, percent), fragments

    star, fragments = verified(upright(side("low").union(side("high"))))
    near = components(star)
    joined = member.select("g", "node", "n", "place", "seen").join(near, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = joined.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("g")
    open_ = joined.join(split, "g").distinct()
    x = open_.select("g", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("seen").alias("sa"), F.col("comp").alias("ca"))
    y = open_.select("g", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("seen").alias("sb"), F.col("comp").alias("cb"))
    rest = x.join(y, "g").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _possible("a", "b", percent)).select("a", "na", "b", "nb")
    across, more = verified(rest)
    links = staged(star.union(across).distinct(), "links")
    known = fragments.select("node").distinct()
    return nodes, components(links), fragments.union(more.join(known, "node", "left_anti").select(fragments.columns))


def _labels(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, component_id): the least key of the component of every node with n-grams."""
    label = nodes.where("n > 0").select("key", "node").join(near, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = label.groupBy("comp").agg(F.min("key").alias("component_id"))
    return label.select("node", "comp").distinct().join(least, "comp").select("node", "component_id")


def jaccard_join(documents: DataFrame, k: int = 4, percent: int = 85, hot: int = HOT, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row of `documents` (text).

    n_links counts the links of the row's set with different sets, all of them.
    """
    nodes, near, fragments = _groups(documents, k, percent, hot, key)
    count = staged(_counted(fragments, near, percent), "counts")
    by_node = _labels(nodes, near).join(count, "node", "left")
    own = nodes.join(by_node, (nodes["node"] == by_node["node"]) & (nodes["n"] > 0), "left")
    return own.select(nodes["key"].alias(key), nodes["n"].alias("n_shingles"), F.coalesce(by_node["component_id"], nodes["key"]).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """The rows, all columns, whose key is the smallest of its group; of repeated rows one stays.

    Rows without words are groups of their own.
    """
    nodes, near, _ = _groups(documents, k, percent, HOT, key)
    by_node = _labels(nodes, near)
    own = nodes.join(by_node, (nodes["node"] == by_node["node"]) & (nodes["n"] > 0), "left").select("key", F.coalesce("component_id", "key").alias("component_id"))
    first = own.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("_first")).distinct()
    kept = documents.join(first, documents[key].eqNullSafe(first["_first"]), "left_semi")
    return kept.dropDuplicates([key, "text"])
