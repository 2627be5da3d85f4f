"""Operator 6: mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

A source's target is its weighted share of the budget (a factor of all tokens), at most ``epochs``
times its size; what is over goes to the other sources by weight until none is above. Each source's
documents are put in a seeded order, ``epochs`` times over. A copy's virtual finish time is the
source's tokens up to and including it divided by the source's target, so a source reaches 1 when it
has its target. All copies are range-sorted by finish time and the mix is cut where the running total
would pass the budget.

Rows that nothing tells apart are one weighted row until their places in the order are known, so null
ids are a row for each size and source. Running sums are taken in two levels, so a source with a third of all rows is no task of its own:
the seeded order of each source is cut into slices, sums of slices are added up per source, and rows
per slice. The global cut works the same way on slices of finish time. The number of slices follows
the number of rows (SLICE_ROWS).

Defined results: a null or empty text has size 0 and its copies stand with the finish time of the
copies before them; null is a source of its own, last in order; a source without tokens has target 0
and its documents are not taken; null ids are ordered first; repeated rows are mixed each for itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS = 1.5, 2
#: Rows in a slice, on average over all sources.
SLICE_ROWS = 4000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: list[str] = []) -> DataFrame:  # noqa: B006
    """``(doc_id, source, size)`` and the ``extra`` columns: the number of words in each text."""
    return docs.select(*extra, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``(source, source_size)``, one row per source.

    Sources are filled in the order of limit / weight: while a source's limit is below its share of
    what is left, it takes its limit. One row per source goes through the ordered windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = source_sizes.select("source", F.col("source_size").cast("double").alias("n"), w.cast("double").alias("weight"))
    limit = F.col("n") * epochs
    fill = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "all": F.sum("n").over(everything) * budget,
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "limits": F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
        }
    )
    # the share per weight if all sources before, and none from here on, are at their limits
    s = s.withColumn("share", (F.col("all") - F.col("limits")) / F.col("left_weight"))
    full = limit <= F.col("share") * F.col("weight")
    # from the first source that is not full on, all have the same share
    s = s.withColumn("level", F.min(F.when(~full, F.struct(F.col("limits"), F.col("share")))).over(everything)["share"])
    target = F.when(full | F.col("level").isNull(), limit).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", F.col("n").cast("long").alias("source_size"), "weight", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], slice_col: str, order: list, value: str, out: str, place: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and including the row, in the order of slices and then
    ``order``, for each key; sums of slices are found first. ``place``: also the row's number in its slice."""
    cells = rows.groupBy(*keys, slice_col).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, slice_col, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, slice_col).orderBy(*order)
    found = rows.withColumn("_run", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if place:
        found = found.withColumn(place, F.row_number().over(within))
    return found.join(cells, [*keys, slice_col]).withColumn(out, F.col("_base") + F.col("_run")).drop("_base", "_run")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 11, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """``(doc_id, source, size, extra, source_size, target, copies)`` for each row of ``sizes``; ``copies``
    says how often the mix holds the row. ``sized`` should be a stored table: it is read several times. Runs jobs."""
    slices = max(64, sized.count() // SLICE_ROWS)
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[F.col(c).cast("string") for c in extra]))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("key")
    # rows that nothing tells apart are one, with a number
    alike = sized.groupBy("doc_id", "source", "size", *extra).agg(F.count(F.lit(1)).alias("rows"))
    rows = alike.select("doc_id", key, "size", mark.alias("mark"), "rows", (F.col("rows") * F.col("size")).alias("held"), *extra)
    # slices of the seeded order, by the first 32 bits of the mark
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * slices / 2**32))
    rows = _running(rows, ["key"], "slice", ["mark", "doc_id", "size", *extra], "held", "upto", "place")
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs)
    # stored, since copies are read twice: their sums of slices would repeat all the plan above
    rows = materialize(rows.join(by_source.withColumn("key", key), "key").drop("mark", "held"), "mix-rows")
    # each of them for itself again, in runs that are dealt out before they are taken apart
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SLICE_ROWS)))
    nth = F.explode(F.sequence(F.col("run") * SLICE_ROWS, F.least(F.col("rows"), (F.col("run") + 1) * SLICE_ROWS) - 1))
    copies = rows.withColumn("run", runs).repartition("key", "slice", "place", "run").withColumn("nth", nth).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    upto = F.col("upto") - (F.col("rows") - F.col("nth") - 1) * F.col("size")
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + upto) / F.col("target")))
    # a target of 0 is never reached: such copies come last, in slices of their own
    copies = copies.withColumn("finish_slice", F.coalesce(F.floor(F.col("finish") * slices), 10**12 + F.col("slice")))
    order = [F.asc("finish"), F.col("source").asc_nulls_last(), F.asc("doc_id"), F.asc("size"), F.asc("epoch")]
    copies = _running(copies, [], "finish_slice", order, "size", "running")
    total = sized.agg(F.floor(F.sum("size") * F.lit(budget)).alias("_budget"))
    # the budget is one row
    copies = copies.join(F.broadcast(total), F.lit(True)).withColumn("in", (F.col("target") > 0) & (F.col("running") <= F.col("_budget")))
    whole = copies.groupBy("key", "slice", "place", "nth").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", *extra, "source_size", "target")], F.count_if(F.col("in")).alias("copies"))
    return whole.drop("key", "slice", "place", "nth")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all their columns. Rows
    are told apart by two hashes of all columns; equal rows are one with a number, as which they are taken.
    Runs jobs, since it stores the sizes and how often rows are taken."""
    hashes = ["_mix_a", "_mix_b"]
    hashed = docs.select("*", F.xxhash64(*docs.columns).alias("_mix_a"), F.xxhash64(F.lit("b"), *docs.columns).alias("_mix_b"))
    sized = materialize(sizes(hashed, id_col, text_col, source_col, hashes), "sizes")
    taken = mix(sized, extra=hashes, **parameters).groupBy(*hashes).agg(F.sum("copies").alias("_mix_copies")).where("_mix_copies > 0")
    taken = materialize(taken, "mix-taken")
    whole = hashed.groupBy(*hashes).agg(F.first(F.struct(*docs.columns)).alias("_mix_row"))
    # in runs, so that no list of copies is long
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_copies") - 1) / SLICE_ROWS)))
    run = whole.join(taken, hashes).select("_mix_row", "_mix_copies", runs.alias("_mix_run"))
    own = F.least(F.col("_mix_copies") - F.col("_mix_run") * SLICE_ROWS, F.lit(SLICE_ROWS))
    return run.select("_mix_row", F.explode(F.sequence(F.lit(1).cast("long"), own)).alias("_mix_copy")).select("_mix_row.*")
