"""Mixing sources to target weights.

Every row gets a hash-random key.  Sizes are summed by range of that key within
each source, prefix sums over the ranges' totals and then inside one range find
the key at which a source's budget is reached, and the source is cut there.  A budget above the
source's size repeats the source: whole epochs first, then a part of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, word_count

#: A source is repeated this often at most.
MAX_EPOCHS = 3
#: Key ranges hold about this many rows.
RANGE_ROWS = 8_192
#: Plans of up to this many sources are broadcast.
BROADCAST_SOURCES = 10_000


def random_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))


def budgets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  With sources by
    ascending size per weight, a source is capped exactly if an equal share of
    what the sources before it leave over would exceed its cap, so one pass of
    prefix sums gives the result of resharing until no target is above its cap.
    """
    listed = sizes.withColumn(
        "weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_epochs
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = listed.withColumn("_level", left.cast("double") / weights_left)
    # Exact in integers: level * weight >= cap
    shared = shared.withColumn("_capped", left * F.col("weight") >= cap * weights_left)
    level = F.min(F.when(~F.col("_capped"), F.struct("_order", "_level"))).over(everything)["_level"]
    shared = shared.withColumn("_order", F.row_number().over(up))
    return shared.select("source", "source_size", "weight", F.when(
        F.col("_capped"), cap.cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with their random key, and a non-null key for their source (null is a source of its own)."""
    return rows.withColumn("_key", random_key(F.col("doc_id"), seed)).withColumn(
        "_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))


def _span(ranges: int) -> Column:
    """Key range of a row: keys are uniform hashes, so equal spans of their first 32 bits hold equal shares."""
    return F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int")


def _place() -> Column:
    return F.struct(F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"))


def source_cuts(rows: DataFrame, ranges: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: target, whole epochs, and where the last epoch is cut.

    Totals per (source, key range) come from partial sums; prefix sums over them
    find the one range in which a source reaches its budget, and only the rows of
    that range are sorted and summed one by one.
    """
    keyed = rows.withColumn("_range", _span(ranges))
    totals = materialise(keyed.groupBy("_source", "source", "_range").agg(F.sum("size").alias("_sum")), "mix_totals")
    plan = budgets(totals.groupBy("source").agg(F.sum("_sum").alias("source_size")), max_epochs)
    plan = _keyed(plan.withColumn("doc_id", F.lit(None)), 0).drop("_key", "doc_id", "source")
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)).cast("int")
    plan = materialise(plan.withColumn("whole", F.coalesce(whole, F.lit(0))), "mix_plan")
    rest = F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
                .join(plan, "_source").withColumn("_rest", rest)
                .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum")))
                .select("_source", "_range", "_before", "_rest"))
    crossing = materialise(crossing, "mix_crossing")
    inside = Window.partitionBy("_source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # Rows that tie are counted before they are put in order.  The last tie that starts before the
    # budget, and how many words of each of its rows still fit.
    words = F.col("n") * F.col("size")
    start = F.col("_upto") - words
    part = F.least(F.round((F.col("_rest") - start) / F.col("n")).cast("long"), F.col("size"))
    ties = keyed.join(crossing, ["_source", "_range"]).groupBy("_source", "_before", "_rest", "_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    last = (ties.withColumn("_upto", F.col("_before") + F.sum(words).over(inside))
            .where((start < F.col("_rest")) & (F.col("size") > 0))
            .groupBy("_source").agg(F.max(F.struct(_place().alias("cut"), part.alias("part"))).alias("_last"))
            .select("_source", "_last.*"))
    return (plan.join(crossing.select("_source", F.col("_range").alias("cut_range")), "_source", "left")
            .join(last, "_source", "left"))


def mix(rows: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with ``doc_id``, ``source`` and ``size``, and per row ``source_size``, ``target``,
    ``copies``, ``part`` and ``taken``; columns of these five names are replaced, others stay.

    A row is taken ``copies`` times whole and, where its source reaches the budget within
    it, ``part`` of its size once more: ``taken`` = copies * size + part, and a source's
    taken sizes add up to its target, rounded.  Keys depend on doc_id and the seed alone,
    so reruns agree.  A size of null counts as 0; rows of size 0 cost no budget and are
    taken once.  Rows of equal doc_id, source and size tie: where the cut falls among them
    they share the words left, rounded to whole words each.  A source that holds most rows
    is spread over many ranges.
    """
    names = [c for c in rows.columns if c not in ("source_size", "target", "copies", "part", "taken")]
    rows = _keyed(rows.select(*names).withColumn("size", F.coalesce("size", F.lit(0)).cast("long")), seed)
    slim = materialise(rows.select("doc_id", "source", "_source", "size", "_key"), "mix_keys")
    ranges = max(1, -(-slim.count() // range_rows))
    cuts = materialise(source_cuts(slim, ranges, max_epochs), "mix_cuts")
    # Few sources are broadcast, so no row moves; any other number is joined by a shuffle.
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    span = _span(ranges)
    within = span == F.col("cut_range")
    before = (span < F.col("cut_range")) | (within & (_place() < F.col("cut")))
    at = within & (_place() == F.col("cut"))
    size = F.col("size")
    again = (F.coalesce(before, F.lit(False)) | F.coalesce(at & (F.col("part") == size), F.lit(False))).cast("int")
    part = F.when(F.coalesce(at, F.lit(False)) & (F.col("part") < size), F.col("part")).otherwise(F.lit(0)).cast("long")
    mixed = rows.join(cuts, "_source")
    mixed = mixed.select(*names, "source_size", "target",
                         F.when(size == 0, F.lit(1)).otherwise(F.col("whole") + again).alias("copies"),
                         F.when(size == 0, F.lit(0)).otherwise(part).alias("part"))
    return mixed.withColumn("taken", F.col("copies") * size + F.col("part"))


def mix_documents(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix over a documents table; a document's size is its number of words (null text: 0)."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix_sizes")
    return mix(sized, seed, max_epochs)


def repeat_documents(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, same columns.

    Texts stay whole: the document in which a source reaches its budget is in if that
    brings the source nearer to it.  Documents without words stay once.  Texts do not
    move: each row learns its number of copies from its source's cut.
    """
    names = docs.columns
    clash = {n: f"_c{i}" for i, n in enumerate(names) if n not in ("doc_id", "source")}
    renamed = docs.select("doc_id", "source", *(F.col(f"`{n}`").alias(c) for n, c in clash.items()))
    mixed = mix(renamed.withColumn("size", word_count(F.col(clash["text"]))), seed, max_epochs)
    times = F.col("copies") + (2 * F.col("part") >= F.col("size")).cast("int") * (F.col("part") > 0).cast("int")
    copies = mixed.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*(F.col(clash.get(n, n)).alias(n) for n in names))
