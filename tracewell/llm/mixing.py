"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import MAX_BUCKETS, ROWS_PER_BUCKET, landed, prefix_sums

BLOCK = 16_384
GRID = 1_000


def tempered_shares(totals: DataFrame, grid: int = GRID) -> DataFrame:
    """Integer shares proportional to total ** 0.75 for (queue, total): large sources are held back, small ones raised."""
    root = totals.withColumn("_t", F.sqrt("total") * F.sqrt(F.sqrt("total")))
    whole = root.agg(F.sum("_t")).first()[0] or 1.0
    return root.select("queue", F.greatest(F.floor(F.col("_t") / F.lit(whole) * grid), F.lit(1)).cast("long").alias("share"))


def cycle(shares: DataFrame) -> DataFrame:
    """One hyperperiod of the Pfair schedule of integer shares: (queue, share, period, job, slot).

    Job j of a source with share a in a period of A slots is released at floor(j A / a) and due at ceil((j + 1) A / a).
    Every slot goes to the released job with the earliest deadline (ties to the smaller name). The shares fill the period
    exactly, so no job is late, no slot idle, and a source is never a whole block away from its share. The schedule
    repeats, so only this period (the sum of the shares, a parameter that data don't raise) is laid out step by step.
    """
    one = shares.agg(F.sort_array(F.collect_list(F.struct("queue", "share"))).alias("q"), F.sum("share").alias("period"))

    def step(state: Column, slot: Column) -> Column:
        def job(i: Column) -> Column:
            share, done = F.col("q")[i]["share"], F.element_at(state["done"], i.cast("int") + 1)
            due = F.ceil((done + 1) * F.col("period") / share)
            return F.when(F.floor(done * F.col("period") / share) <= slot, F.struct(due.alias("due"), i.cast("int").alias("i")))

        best = F.array_min(F.transform(F.sequence(F.lit(0), F.size("q") - 1), job))["i"]
        return F.struct(F.transform(state["done"], lambda d, k: F.when(k == best, d + 1).otherwise(d)).alias("done"),
                        F.concat(state["slots"], F.array(best)).alias("slots"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), F.size("q")).alias("done"), F.array().cast("array<int>").alias("slots"))
    laid = one.filter("period > 0").select("q", "period", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step)["slots"].alias("slots"))
    slots = laid.select("q", "period", F.posexplode("slots").alias("slot", "i"))
    slots = slots.select(F.col("q")[F.col("i")]["queue"].alias("queue"), F.col("q")[F.col("i")]["share"].alias("share"), "period",
                         F.col("slot").cast("long").alias("slot"))
    return slots.withColumn("job", (F.row_number().over(Window.partitionBy("queue").orderBy("slot")) - 1).cast("long"))


def mix(docs: DataFrame, shares: DataFrame | None = None, *, block: int = BLOCK, grid: int = GRID, epochs: bool = True,
        size: Column | None = None) -> DataFrame:
    """Interleave sources block by block: docs' columns plus (epoch, block, slot, start).

    Each source's documents, ordered by md5 of their id, form a stream measured in characters (text and one end character;
    ``size`` measures otherwise) and cut into blocks; ``cycle`` gives every block its slot, and (slot, start) orders the mixture. A document belongs to
    the block in which it starts. The schedule ends when every source has been read once; with ``epochs`` shorter sources
    are read again until then, so that the whole mixture has the target shares, and no document is left out. Without, each
    document appears once, and the shares hold as long as all sources last.

    ``shares`` has (source, share) with whole numbers, by default tempered by size. A null source is a source; a source
    without a share gets 1; a null text is empty; repeated rows are kept as often as they come; an empty table gives an
    empty mixture. Other columns pass through; columns that are named like the four new ones are replaced.
    """
    docs = docs.drop("epoch", "block", "slot", "start")
    queue = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    size = F.length(F.coalesce("text", F.lit(""))) + F.lit(1).cast("long") if size is None else size
    named = F.col("doc_id").cast("string")
    named = F.coalesce(named, F.col("text"), F.lit("")) if "text" in docs.columns else F.coalesce(named, F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), queue.alias("queue"), size.alias("_size"),
                       F.md5(named.cast("binary")).alias("_h"))
    narrow = rows.select("queue", "_size")
    totals = narrow.groupBy("queue").agg(F.sum("_size").alias("total"), F.count(F.lit(1)).alias("rows"))
    if shares is None:
        target = tempered_shares(totals.select("queue", "total"), grid)
    else:
        named = shares.select(F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("queue"), F.col("share").cast("long"))
        target = totals.join(named, "queue", "left").select("queue", F.coalesce("share", F.lit(1)).cast("long").alias("share"))
    plan = landed(cycle(target), "cycle")
    # the last first-epoch block of each source, and with it the length of the schedule
    final = totals.withColumn("last", F.floor((F.col("total") - 1) / block)).join(plan, "queue")
    final = final.filter("last % share = job").select("queue", "total", "share", "period", ((F.floor(F.col("last") / F.col("share"))) * F.col("period") + F.col("slot")).alias("end"))
    end = final.agg(F.max("end")).first()[0] or 0
    reach = final.withColumn("end", F.lit(end)).withColumn("blocks", (F.floor(F.col("end") / F.col("period")) + 1) * F.col("share"))
    width = max(0, min(3, (int(totals.agg(F.max("rows")).first()[0] or 0) // ROWS_PER_BUCKET).bit_length() // 4 + 1))
    streamed = prefix_sums(rows, ["queue"], ["_h", "_size"], F.substring("_h", 1, width), "_size", "_start")
    read = streamed.join(F.broadcast(reach), "queue")  # both tables have no more rows than the period has slots
    last_epoch = F.floor((F.col("blocks") * block - 1) / F.col("total")) if epochs else F.lit(0).cast("long")
    read = read.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_epoch)).alias("epoch"))
    read = read.withColumn("_at", F.col("_start") + F.col("epoch") * F.col("total")).withColumn("block", F.floor(F.col("_at") / block))
    read = read.withColumn("job", F.col("block") % F.col("share")).join(F.broadcast(plan.select("queue", "job", "slot")), ["queue", "job"])
    read = read.withColumn("slot", F.floor(F.col("block") / F.col("share")) * F.col("period") + F.col("slot"))
    return read.filter((F.col("slot") <= F.col("end")) | (F.col("epoch") == 0)).select(
        "_row.*", "epoch", "block", "slot", (F.col("_at") % block).alias("start"))


assert MAX_BUCKETS >= 16 ** 3  # widest bucket of the md5 order
