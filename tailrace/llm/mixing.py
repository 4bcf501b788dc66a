"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within a source documents stand in key order; the order is cut
into key ranges, the ranges' token sums are added up into offsets, a running sum inside a range does
the rest, so no source is ever sorted by one task. The source's budget is cut exactly: whole epochs
first, then the start of the order up to the budget, the document at the cut in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.llm.common import WORD, checkpointed, written

#: Weights of the sources in code point order, repeating, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated this many times at most.
EPOCHS = 3
#: Rows of one source in a key range, on average.
RANGE_ROWS = 2_000
#: Named in the keys: another seed, another order.
SEED = 7


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size) with the target of each.

    All sizes together are shared by weight; a target stops at `epochs` times its source's size and
    the excess is shared again by weight until no target is above. In order of size over weight the
    stopped sources come first, so the fixed point is found with running sums over the sources' rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    total = Window.partitionBy()
    s = sources.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * float(epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.select(
        "source", "source_size", "w", "cap",
        F.sum("source_size").over(total).cast("double").alias("all"),
        (F.sum("cap").over(by_ratio) - F.col("cap")).alias("stopped"),
        (F.sum("w").over(total) - F.sum("w").over(by_ratio) + F.col("w")).alias("left"),
    )
    # the level if exactly the sources before this one stop; the first that stays below its cap has the largest such level
    level = (F.col("all") - F.col("stopped")) / F.col("left")
    s = s.withColumn("fits", F.when(level * F.col("w") <= F.col("cap"), level)).withColumn("level", F.max("fits").over(total))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def keyed(docs: DataFrame, seed: int = SEED, *more: Column) -> DataFrame:
    """(doc_id, source, size, key, *more) of docs(doc_id, text, source)."""
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("key")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(text).alias("size"), key, *more)


def range_of(ranges: int) -> Column:
    """Uniform keys: equal key ranges hold equal shares of every source."""
    return (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def range_sums(sized: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """(source, range, range_size, offset, source_size, target, whole, budget) of sized(source, range,
    size): offset is what the ranges before hold; budget words are taken beyond whole epochs."""
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    # no more than whole epochs, whatever rounding does to the target
    budget = F.least(F.floor("target"), F.col("source_size") * epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("budget", budget - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    return sums.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def taken_of(*order: str) -> Column:
    """What the mix takes of a row of the joined tables."""
    inside = Window.partitionBy("d.source", "d.range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - before))
    return (F.col("whole") * F.col("size") + part).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs.

    size counts the words (null text: 0); taken is the words that the mix takes of the document,
    repeats counted; the taken of a source sum up to its target, rounded down. Documents of size
    zero take nothing. A null source is a source of its own, the last. Rows that repeat an id are
    documents of their own; among equal keys the smaller size goes first. Rows without id are
    documents of their own too, by the hash of their texts. Empty table: no rows.
    """
    sized = checkpointed(keyed(docs, seed))
    sized = sized.withColumn("range", range_of(max(1, -(-sized.count() // range_rows))))
    sums = range_sums(sized, weights, epochs)
    same = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range"))
    return sized.alias("d").join(sums.alias("r"), same).select("d.doc_id", "size", "source_size", "target", taken_of("key", "doc_id", "size").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of docs as the mix takes them, all their columns: each once for every epoch that takes
    it, the one at the cut whole. What mix() says of nulls and repeats holds here. Documents without
    words are kept once; they weigh nothing. Empty table: no rows.

    Of a source only the range with the cut is put in order; in the ranges before it every row is
    taken once more than behind it, so no other row moves.
    """
    names = docs.columns
    sized = keyed(docs.select("doc_id", "text", "source"), seed)
    ranges = max(1, -(-docs.count() // range_rows))
    sums = checkpointed(range_sums(sized.select("source", "size", range_of(ranges).alias("range")), weights, epochs))
    cut = sums.groupBy("source").agg(F.first("whole").alias("whole"), F.first("budget").alias("budget"), F.max(F.when(F.col("offset") < F.col("budget"), F.col("range"))).alias("cut"))
    # a row a source, written so that its size is known: a small one is broadcast, a large one joined by exchange
    cut = written(cut, "cuts")
    rows = keyed(docs, seed, F.struct(*(docs[c] for c in names)).alias("row")).withColumn("range", range_of(ranges))
    rows = rows.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    # without a cut the budget beyond whole epochs is nothing
    apart = rows.where(~F.coalesce(F.col("range") == F.col("cut"), F.lit(False)))
    apart = apart.select("row", "size", (F.col("whole") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)).alias("times"))
    there = rows.where("range = cut").select("d.*").alias("d")
    same = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range"))
    # a row's own bytes are the last thing that tells it from its equals
    there = there.join(sums.alias("r"), same).withColumn("bytes", F.to_json(F.col("row"))).select("row", "size", taken_of("key", "doc_id", "size", "bytes").alias("taken"))
    there = there.select("row", "size", F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).alias("times"))
    both = apart.select("row", "size", F.col("times").cast("int")).unionAll(there.select("row", "size", F.col("times").cast("int")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select(*(F.col("row")[c].alias(c) for c in names))
