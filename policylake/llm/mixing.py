"""Mixing sources to target weights with exact quotas per output shard; DataFrame functions only.

The documents of a source, in hashed order, form one stream of words. The target is drawn from it
in up to `epochs` passes; the last pass ends at the word that meets the target, so at most one
document of a source is cut, and all others are taken whole in every pass. A pass is cut into
blocks of equal numbers of words; a document belongs to the block in which it starts. A source's
quota is the number of blocks in its passes. A splitting tree shares the quotas out among the
shards: a node with quotas q and 2^k shards gives its left half a multivariate hypergeometric draw
of half its blocks and the rest to its right half, down to single shards, so that every shard has
a fair share of every source and the quotas hold exactly. Each shard then takes its own run of a
source's permuted blocks, and its documents are put in hashed order.

Targets: `share` of all words by weight; a target stops at `epochs` times its source, the excess
goes to the others by weight until none is above (a water level). Weights repeat over the sources
in code point order, null last.

Everything is a function of keys and `seed`, so reruns and lost tasks give the same mix. Prefix
sums go by (source, hash bucket) and carry bucket totals, so a hot source is many small windows.
Tables of one row per source and one per (source, shard) are the only ones gathered; the largest
array holds one number per source.

A null or empty text has size 0 and is never taken. Rows with the same key and text are counted
one by one; which of two equal rows is taken makes no difference. Sources are compared as they
are; null is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a window of a source, about.
BUCKET = 2_000
#: Blocks of a pass, about, and words in a block: at least (a 32nd of a small source) and at most.
BLOCKS, LEAST_WORDS, MOST_WORDS = 65_536, 512, 8_192


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def _sources(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target, block, drawn and passes by epoch, quota) of every source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    of = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every, ratio = Window.partitionBy(), Window.orderBy("full", F.col("source").asc_nulls_last())
    level = (F.col("all") - F.col("cut")) / F.col("open")
    ranked = (
        of.withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * float(epochs))
        .withColumn("full", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(every) * share)
        .withColumn("cut", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("water", F.max(F.when(F.col("full") > level, level)).over(every))
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap"))
    least = F.least(F.lit(LEAST_WORDS), F.ceil(F.col("source_size") / 32))
    block = F.greatest(F.lit(1), least, F.least(F.lit(MOST_WORDS), F.ceil(F.col("source_size") / BLOCKS))).cast("long")
    cut = ranked.select("source", "source_size", target.alias("target"), block.alias("block"))
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("source_size"), F.round("target").cast("long") - e * F.col("source_size")))
    cut = cut.withColumn("drawn", F.array(*(words(e) for e in range(epochs))))
    cut = cut.withColumn("passes", F.transform("drawn", lambda x: F.ceil(x / F.col("block")).cast("long")))
    return cut.withColumn("quota", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x))


def _log_factorial(x: str) -> str:
    """ln x! of a whole number: exact products below 10, else Stirling's series (error below 1e-12)."""
    small = "element_at(array(0D, 0D, ln(2D), ln(6D), ln(24D), ln(120D), ln(720D), ln(5040D), ln(40320D), ln(362880D)), cast({0} as int) + 1)"
    series = "(({0} + 0.5D) * ln({0}) - {0} + 0.91893853320467274178D + 1D / (12 * {0}) - 1D / (360 * pow({0}, 3)) + 1D / (1260 * pow({0}, 5)) - 1D / (1680 * pow({0}, 7)))"
    return f"IF({x} < 10, {small.format(f'least({x}, 9)')}, {series.format(f'greatest(cast({x} as double), 10D)')})"


def hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL: how many of `draws` from `total` are among the `good`, at the quantile u.

    Sums the chances over the support within 9 standard deviations of the mean (what lies beyond
    is below the precision of a double) and stops where the sum passes u.
    """
    f = _log_factorial
    chance = (
        f"exp({f('p.g')} - {f('x')} - {f('(p.g - x)')} + {f('(p.t - p.g)')} - {f('(p.d - x)')} - {f('(p.t - p.g - p.d + x)')}"
        f" - {f('p.t')} + {f('p.d')} + {f('(p.t - p.d)')})"
    )
    mean, spread = "(p.d * 1D * p.g / p.t)", "sqrt(greatest(p.d * 1D * p.g / p.t * (1 - p.g * 1D / p.t) * (p.t - p.d) / greatest(p.t - 1, 1), 0D))"
    low = f"greatest(0L, p.d + p.g - p.t, cast(floor({mean} - 9 * {spread}) as long) - 2)"
    high = f"least(p.g, p.d, cast(ceil({mean} + 9 * {spread}) as long) + 2)"
    walk = (
        f"aggregate(sequence({low}, {high}), named_struct('sum', 0D, 'at', {low}), "
        f"(a, x) -> IF(a.sum >= p.u, a, named_struct('sum', a.sum + {chance}, 'at', x)), a -> a.at)"
    )
    bound = f"named_struct('t', {total}, 'g', {good}, 'd', {draws}, 'u', {u})"
    return f"IF({total} = 0, 0L, transform(array({bound}), p -> {walk})[0])"


def splitting_tree(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, source, first, count): each shard's run of every source's permuted blocks."""
    root = sources.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("order"), F.col("source").isNull().alias("void"), "source", "quota"))).alias("all"))
    node = root.select(F.lit(0).cast("long").alias("shard"), F.transform("all", lambda x: x["source"]).alias("names"), F.transform("all", lambda x: x["quota"]).alias("quota"))
    node = node.withColumn("first", F.transform("quota", lambda x: F.lit(0).cast("long")))
    for level in range(levels):
        u = f"(shiftrightunsigned(xxhash64({seed}, {level}, shard, i), 12) + 0.5D) / 4503599627370496D"
        draw = hypergeometric("a.total", "q", "a.draws", u)
        total = "aggregate(quota, 0L, (s, q) -> s + q)"
        step = (
            f"aggregate(sequence(1, size(quota)), named_struct('total', {total}, 'draws', {total} div 2, 'out', cast(array() as array<long>)), "
            f"(a, i) -> transform(array(element_at(quota, i)), q -> transform(array({draw}), x -> "
            "named_struct('total', a.total - q, 'draws', a.draws - x, 'out', concat(a.out, array(x))))[0])[0], a -> a.out)"
        )
        half = node.where("size(quota) > 0").withColumn("left", F.expr(step))
        rest = F.zip_with("quota", "left", lambda q, x: q - x)
        after = F.zip_with("first", "left", lambda f, x: f + x)
        both = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quota"), "first"),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), rest.alias("quota"), after.alias("first")),
        )
        node = half.select("names", F.explode(both).alias("n")).select(F.col("n.shard").alias("shard"), "names", F.col("n.quota").alias("quota"), F.col("n.first").alias("first"))
        if level % 6 == 5:
            node = node.repartition("shard")
    return node.select("shard", F.explode(F.arrays_zip("names", "first", "quota")).alias("r")).select("shard", F.col("r.names").alias("source"), F.col("r.first").alias("first"), F.col("r.quota").alias("count"))


def _streams(documents: DataFrame, key: str, seed: int) -> DataFrame:
    """(id, source, size, row, start): each row's place in its source's stream of words."""
    text = F.col("text").cast("string")
    order = F.xxhash64(F.lit(seed), F.col(key), text)
    slim = staged(documents.select(F.col(key).alias("id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), order.alias("order")), "sizes")
    rows = slim.count()
    buckets = max(1, rows // BUCKET)
    bucket = F.pmod(F.xxhash64("order"), F.lit(buckets)).alias("bucket")
    dealt = slim.select("*", bucket)
    per = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_row"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("order", "id", "size")))
    joined = placed.alias("p").join(base.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")))
    return joined.select("p.id", "p.source", "p.size", "p.order", (F.col("base_row") + F.col("nth")).alias("row"), (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, shard_words: int = 8_388_608, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """Every row in every pass, drawn or not: id, source, size, source_size, target, order, row, epoch,
    block, words (its first so many are taken), shard (null: not drawn), slot (order in the shard).
    """
    rows = staged(_streams(documents, key, seed), "streams")
    sources = staged(_sources(rows, weights, share, epochs), "sources")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    levels = max(0, int(total / shard_words)).bit_length()
    runs = staged(splitting_tree(sources.where("quota > 0"), levels, seed), "shards")
    drawn = runs.where("count > 0").select("source", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("position"))
    known = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", "block", "drawn", "passes")
    copies = known.select("*", F.posexplode("drawn").alias("epoch", "pass_words"))
    copies = copies.withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("pass_words") - F.col("start"))))
    nth, blocks = F.floor(F.col("start") / F.col("block")), F.element_at("passes", F.col("epoch") + 1)
    # a prime above every number of blocks steps through all of them
    permuted = F.pmod(nth * F.lit(2654435761) + F.pmod(F.xxhash64(F.lit(seed), "source", "epoch"), F.lit(1 << 30)), blocks)
    before = F.aggregate(F.slice("passes", F.lit(1), F.col("epoch")), F.lit(0).cast("long"), lambda a, x: a + x)
    copies = copies.withColumn("position", F.when(F.col("words") > 0, permuted + before))
    got = copies.alias("c").join(drawn.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c.position") == F.col("d.position")), "left")
    return got.select(
        F.col("c.id").alias("id"), F.col("c.source").alias("source"), "size", "source_size", "target", "order", "row", "epoch",
        nth.alias("block"), "words", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(seed), "d.shard", "order", "row", "epoch").alias("slot"),
    )


def taken(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, size, source_size, target, taken, n_shards) of every row that was mixed."""
    words = F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)
    one = mixed.groupBy("source", "row", "id", "size", "source_size", "target").agg(F.sum(words).alias("taken"), F.count_distinct("shard").alias("n_shards"))
    return one.select(F.col("id").alias(key), "size", "source_size", "target", "taken", "n_shards")


def drawn(documents: DataFrame, mixed: DataFrame, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """The mix as rows of `documents` (all columns), shard by shard in drawn order, repeats as repeated rows.

    The text of the one document of a source that ends its last pass is cut after its last taken
    word (n_chars, where there is such a column, follows). Whole rows travel twice: to the plan of
    their key, and to their shard. `documents` may have columns of any name.
    """
    text = F.col("doc.text").cast("string")
    # rows dealt by order are numbered and joined (by order and number) without being dealt again
    documents.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own = documents.select(F.struct("*").alias("doc"), F.xxhash64(F.lit(seed), F.col(key), F.col("text").cast("string")).alias("order"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("order").orderBy("order")))
    plan = mixed.where(F.col("shard").isNotNull() & (F.col("words") > 0))
    plan = plan.select("order", F.dense_rank().over(Window.partitionBy("order").orderBy("row")).alias("nth"), "size", "words", "shard", "slot")
    got = own.join(plan.hint("merge"), ["order", "nth"])
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.col("words") < F.col("size")
    cut = F.when(short, F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    changed = {"text": cut.cast(documents.schema["text"].dataType)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(short, F.length(cut)).otherwise(F.col("doc.n_chars")).cast(documents.schema["n_chars"].dataType)
    dealt = got.repartition("shard").sortWithinPartitions("shard", "slot")
    return dealt.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
