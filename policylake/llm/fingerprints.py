"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests; DataFrame functions only.

A text is the set of 64-bit digests of its paragraphs: lines, cut behind the first sentence end
after LEAST code points, or else after PIECE code points. A sketch hashes every digest into one cell of each of three rows; a cell holds
a count, the xor of its digests and the xor of their checks. Two versions' sketches subtract cell
by cell, what both share vanishes, and peeling cells that hold one digest recovers the digests in
which they differ. The smallest sketch (3 x SMALL cells) is the published fingerprint and is tried
first; where peeling fails the digests are dealt into groups of about GROUP, each group is
sketched with 3 x 8 cells, a failing group again with 16, then 32 per row. A group that fails even
then (odds below 1e-6) is compared digest by digest, so the result is always whole.

Likeness of two versions is the Jaccard share of their digests, from their numbers and the number
of differing digests; two empty texts are 1 alike. A null text is empty. Grouping is by two levels,
so a text of p paragraphs takes about p^1.5 steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm.staging import staged

LEAST, PIECE, SMALL, GROUP = 48, 160, 4, 16
PARAGRAPH = rf"[^\n]{{{LEAST},{PIECE}}}?[.!?]+\s|[^\n]{{1,{PIECE}}}\n*|\n+"


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text, in text order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _entries(keys: str) -> str:
    return f"transform({keys}, k -> named_struct('k', k, 'h', xxhash64(k, 77L)))"


def _sketch(entries: str, m: int) -> str:
    """SQL: the 3 x m cells of an array of (k, h)."""

    def row(j: int) -> str:
        own = f"filter({entries}, e -> (shiftrightunsigned(e.k, {20 + 14 * j}) & {m - 1}L) = r)"
        return f"transform(sequence(0L, {m - 1}L), r -> aggregate({own}, named_struct('n', 0, 'k', 0L, 'h', 0L), (s, e) -> named_struct('n', s.n + 1, 'k', s.k ^ e.k, 'h', s.h ^ e.h)))"

    return f"concat({row(0)}, {row(1)}, {row(2)})"


def _small(keys: str) -> str:
    """SQL: the published sketch of an array of digests."""
    return f"transform(array({_entries(keys)}), q -> {_sketch('q', SMALL)})[0]"


def _once(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The kept columns and new ones, each computed once per row however often it is used later."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*kept, F.inline(F.array(made)))


def _peeled(a: str, b: str, m: int) -> str:
    """SQL: the digests in which two sketches of m cells a row differ; null if peeling stops early."""
    minus = f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    mine = f"(shiftrightunsigned(p.k, cast(20 + 14 * (i div {m}) as int)) & {m - 1}L) = i % {m}"
    without = f"transform(t.c, (c, i) -> aggregate(filter(pure, p -> {mine}), c, (s, p) -> named_struct('n', s.n - p.n, 'k', s.k ^ p.k, 'h', s.h ^ p.h)))"
    step = (
        "transform(array(array_distinct(filter(t.c, c -> abs(c.n) = 1 AND xxhash64(c.k, 77L) = c.h))), pure -> "
        f"IF(size(pure) = 0, named_struct('c', t.c, 'f', t.f, 'go', false), named_struct('c', {without}, 'f', concat(t.f, transform(pure, p -> p.k)), 'go', true)))[0]"
    )
    end = "IF(forall(t.c, c -> c.n = 0 AND c.k = 0 AND c.h = 0), t.f, NULL)"
    start = "named_struct('c', cells, 'f', cast(array() as array<bigint>), 'go', true)"
    return f"transform(array({minus}), cells -> aggregate(sequence(1, 24), {start}, (t, i) -> IF(t.go, {step}, t), t -> {end}))[0]"


def differing(a: str, b: str, small_a: str, small_b: str) -> Column:
    """The digests that are in one of two digest arrays only, found by peeling ever larger sketches."""

    def attempt(m: int) -> str:
        return _peeled(_sketch("g.a", m), _sketch("g.b", m), m)

    exact = "transform(concat(filter(g.a, e -> NOT array_contains(g.b, e)), filter(g.b, e -> NOT array_contains(g.a, e))), e -> e.k)"
    group = f"coalesce({attempt(8)}, {attempt(16)}, {attempt(32)}, {exact})"
    low = "pmod(shiftrightunsigned(e.k, 12), v.inner) = y"
    inner = f"flatten(transform(sequence(0L, v.inner - 1), y -> transform(array(named_struct('a', filter(w.a, e -> {low}), 'b', filter(w.b, e -> {low}))), g -> {group})[0]))"
    high = "pmod(e.k, v.outer) = x"
    outer = f"flatten(transform(sequence(0L, v.outer - 1), x -> transform(array(named_struct('a', filter(v.a, e -> {high}), 'b', filter(v.b, e -> {high}))), w -> {inner})[0]))"
    n = f"(size({a}) + size({b}))"
    wide = f"greatest(1L, cast(ceil(sqrt({n} / {GROUP}D)) as bigint))"
    bound = f"named_struct('a', {_entries(a)}, 'b', {_entries(b)}, 'outer', {wide}, 'inner', greatest(1L, cast(ceil({n} / {GROUP}D / {wide}) as bigint)))"
    return F.expr(f"coalesce({_peeled(small_a, small_b, SMALL)}, transform(array({bound}), v -> {outer})[0])")


def _published(cells: str) -> str:
    return f"concat_ws(',', transform({cells}, c -> concat(c.n, ':', lower(hex(c.k)))))"


def likeness(a: str, b: str, difference: str) -> Column:
    n, d = F.size(a) + F.size(b), F.size(difference)
    return F.when(n == 0, 1.0).otherwise((n - d) / (n + d))


def _neighbours(documents: DataFrame, key: str) -> DataFrame:
    """(id, tie, next id and tie, previous id and tie, previous n): the ring of rows by descending key, nulls last.

    Rows of equal key follow by a hash of the text; equal rows are one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select(F.col(key).alias("id"), F.xxhash64(text).alias("tie"), F.length(text).alias("n")).distinct()
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    dealt = staged(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    here = Window.partitionBy("part").orderBy(*order)
    row = F.struct("id", "tie", "n")
    inside = dealt.select("*", F.lag(row).over(here).alias("before"), F.lead(F.lit(1)).over(here).alias("more"))
    ends = staged(inside.where("before is null or more is null"), "ends")
    parts = Window.orderBy("part")
    whole = Window.partitionBy()
    last = ends.where("more is null").select("part", F.struct("id", "tie", "n").alias("tail"))
    ring = last.select(F.lead("part").over(parts).alias("part"), F.min("part").over(whole).alias("first"), "tail").select(F.coalesce("part", "first").alias("part"), "tail")
    joined = inside.join(F.broadcast(ring), "part").select("id", "tie", F.coalesce("before", "tail").alias("p"))
    return joined.select("id", "tie", F.col("p.id").alias("before_id"), F.col("p.tie").alias("before_tie"), F.col("p.n").alias("before_n"))


def edited_versions(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, edited (second half replaced by the start of the next document), next_digests."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    around = staged(_neighbours(documents, key), "ring")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    mine = rows.alias("r").join(around.alias("a"), same("r.id", "a.id") & same("r.tie", "a.tie"))
    half = F.floor(F.col("before_n") / 2).cast("int")
    sent = mine.select("before_id", "before_tie", F.substring("text", F.lit(1), half).alias("patch"), digests(F.col("text")).alias("next_digests"))
    one = sent.groupBy("before_id", "before_tie").agg(F.any_value("patch").alias("patch"), F.any_value("next_digests").alias("next_digests"))
    both = rows.alias("r").join(one.alias("s"), same("r.id", "s.before_id") & same("r.tie", "s.before_tie"))
    kept = F.substring("text", F.lit(1), (F.length("text") - F.floor(F.length("text") / 2)).cast("int"))
    return both.select(F.col("id").alias(key), "text", F.concat(kept, F.col("patch")).alias("edited"), "next_digests")


def compared(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints, the digests in which versions differ, likenesses."""
    rows = versions.select(F.col(key).alias("_k"), "text", "edited", F.col("next_digests").alias("c"))
    rows = _once(rows, "_k", "c", n_chars=F.length("text").cast("long"), edited_sha256=F.sha2("edited", 256), a=digests(F.col("text")), b=digests(F.col("edited")))
    small = _once(rows, *rows.columns, **{f"s{x}": F.expr(_small(x)) for x in "abc"})
    diff = _once(small, *small.columns, changed=differing("a", "b", "sa", "sb"), other=differing("a", "c", "sa", "sc"))
    return diff.select(
        F.col("_k").alias(key), "n_chars", "edited_sha256", F.expr(_published("sa")).alias("fingerprint"), F.expr(_published("sb")).alias("edited_fingerprint"),
        likeness("a", "b", "changed").alias("near_edited"), likeness("a", "c", "other").alias("near_next"), "changed",
    )
