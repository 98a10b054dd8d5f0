"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

A document's size is its number of words. Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 ...
and share the budget, which is the sum of all sizes. No target exceeds ``max_epochs`` times its source's
size; what is cut off is shared again by weight among the others.

The documents of a source stand in a shuffled order (MD5 of the id, then of the text, then a row number, so that every
row has a place of its own), repeated ``max_epochs`` times. A copy's
virtual finish time is the cumulative size of its source up to it, divided by the source's target. All
copies are sorted by finish time, and the mix is what comes before the budget is spent.

Size: cumulative sizes need no task that sees a whole source. The rows, without their texts, are sorted by source and
place over all tasks; sizes are summed per source and slot (the task a row was sorted to), the sums run over the slots,
and windows run inside a slot, so an id or a source that a third of all rows share is spread too. The global sort is
resolved the same way: sizes per narrow range of finish times locate the range in which the budget ends, and
only that range is sorted. The place of the cut is one row; sources keep their last copy taken, so texts are
matched with one row per source.

Defined cases: a null text has size 0; a source without words has target 0 and nothing of it is taken; rows
that repeat an id, or have none, are taken one by one, and of rows equal in id, text and source it makes no difference
which; an empty table gives no rows; other columns are not read by ``mix`` and are kept by ``take_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.llm.common import stage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RANGES = 1 << 14

_WORD = r"[^\x20\x09-\x0D]+"


_ROW = "_pvgrid_row"


def _place(id_col: Column, text_col: Column, row: Column) -> Column:
    parts = [F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) for c in (id_col, text_col)]
    return F.concat(*parts, F.lpad(F.hex(row), 16, "0"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, no_src, source_size, target) per source, from (src, no_src, size)."""
    by_name = Window.orderBy("no_src", "src")
    by_need = Window.orderBy("need", "no_src", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = (sizes.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
               .withColumn("weight", F.element_at(table, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
               .withColumn("most", F.col("source_size") * max_epochs)
               .withColumn("need", F.col("most") / F.col("weight"))
               .withColumn("budget", F.sum("source_size").over(everything))
               .withColumn("all_weight", F.sum("weight").over(everything)))
    # those that need least are filled first; the level is what the others would get per unit of weight
    level = ((F.col("budget") - F.coalesce(F.sum("most").over(by_need), F.lit(0)))
             / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_need), F.lit(0))))
    full = F.col("need") < F.col("level")
    sources = sources.withColumn("level", level).withColumn("full", full)
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(
        F.col("weight") * ((F.col("budget") - spent) / rest))
    return sources.select("src", "no_src", "source_size", target.alias("target"), "budget")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, max_epochs: int, row: Column) -> DataFrame:
    """Every document with its source's figures and the source's cumulative size up to it."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    rows = stage(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
                             F.col(source_col).isNull().alias("no_src"), size.alias("size"),
                             _place(F.col(id_col), F.col(text_col), row).alias("at")), "sizes")
    rows = stage(rows.orderBy("no_src", "src", "at").withColumn("slot", F.spark_partition_id()), "in-order")
    slots = rows.groupBy("src", "no_src", "slot").agg(F.sum("size").alias("in_slot"))
    before = Window.partitionBy("src", "no_src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (slots.withColumn("before", F.coalesce(F.sum("in_slot").over(before), F.lit(0)))
             .join(source_targets(rows, weights, max_epochs), ["src", "no_src"]).drop("in_slot"))
    inside = Window.partitionBy("src", "no_src", "slot").orderBy("at")
    return stage(rows.withColumn("inside", F.sum("size").over(inside)).join(slots, ["src", "no_src", "slot"])
                 .withColumn("upto", F.col("before") + F.col("inside")).drop("before", "inside", "slot"), "placed")


def _copies(placed: DataFrame, max_epochs: int) -> DataFrame:
    """A row per copy with its finish time; documents of sources with target 0 have none."""
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    return (placed.where("target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
            .withColumn("finish", finish)
            .withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES))))


def _last_taken(placed: DataFrame, max_epochs: int) -> DataFrame:
    """Per source, the last copy (epoch, place) before the budget is spent."""
    copies = _copies(placed, max_epochs)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("s"), F.max("budget").alias("budget"))
    ranges = ranges.withColumn("upto", F.sum("s").over(Window.orderBy("range")))
    over = ranges.where("upto > budget").orderBy("range").select("range", (F.col("upto") - F.col("s")).alias("before")).first()
    cut, before = (over["range"], over["before"]) if over else (2 * RANGES + 1, 0)
    order = Window.orderBy("finish", "no_src", "src", "epoch", "at")
    edge = (copies.where(F.col("range") == cut).withColumn("spent", F.sum("size").over(order) + before)
            .where("spent <= budget").select("src", "no_src", "epoch", "at"))
    taken = copies.where(F.col("range") < cut).select("src", "no_src", "epoch", "at").unionByName(edge)
    return (taken.groupBy("src", "no_src").agg(F.max(F.struct("epoch", "at")).alias("last"))
            .select("src", "no_src", F.col("last.epoch").alias("last_epoch"), F.col("last.at").alias("last_at")))


_COPIES = "coalesce(last_epoch + IF(at <= last_at, 1, 0), 0)"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: size, source_size, target of its source, copies and the words taken."""
    placed = _placed(docs, id_col, text_col, source_col, weights, max_epochs, F.monotonically_increasing_id())
    cuts = stage(_last_taken(placed, max_epochs), "cuts")
    return (placed.join(cuts, ["src", "no_src"], "left").withColumn("copies", F.expr(_COPIES).cast("long"))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns unchanged."""
    docs = stage(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias(_ROW)), "numbered")
    rows = docs.select("_doc", _ROW, *[F.col(f"_doc.{c}").alias(f"_{n}") for n, c in (("id", id_col), ("text", text_col), ("source", source_col))])
    placed = _placed(rows, "_id", "_text", "_source", weights, max_epochs, F.col(_ROW))
    cuts = stage(_last_taken(placed, max_epochs), "cuts")
    rows = rows.select("_doc", F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("src"), F.col("_source").isNull().alias("no_src"),
                       _place(F.col("_id"), F.col("_text"), F.col(_ROW)).alias("at"))
    return (rows.join(cuts, ["src", "no_src"]).select("_doc", F.expr(_COPIES).alias("copies"))
            .where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*"))
