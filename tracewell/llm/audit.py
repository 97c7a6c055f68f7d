"""Interaction of filters, counted by a stream that takes back what later files make wrong.

All files of the table pass as available-now micro-batches. Every document gets a mask of the conditions that its own
text decides; whether a smaller id has the same text is decided by state keyed on the text. The state holds the smallest
id so far and what was counted for it. When a smaller id arrives, the earlier mask is taken back from the counters of its
part and counted again with the duplicate bit. The counters, one row per part and mask, then give every order of filters.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.llm import common

FILTERS = "ABCDE"
DUPLICATE = 16
#: Micro-batches that a table is read in, at most; each takes as many files.
BATCHES = 4
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: What a row says of its text: it has the least id of its batch, a later one, or none.
LEAST, LATER, NO_ID = 0, 1, 2


def with_mask(rows: DataFrame, text: str) -> DataFrame:
    """Replace ``text`` by ``mask``: bits 1, 2, 4, 8 for conditions A to D of the whole text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    split = rows.withColumn("_w", words).withColumn("_n", F.size("_w"))
    n = F.col("_n")
    fails = [n < 100, F.size(F.array_distinct("_w")) * 100 < n * 80, capitals * 100 > F.length(text) * 10, F.col(text).rlike("[#$%&*|]")]
    return split.withColumn("mask", reduce(lambda a, b: a + b, [F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(fails)])).drop("_w", "_n", text)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text and kind become one with a count, so that a text with very many copies sends few rows."""
    for pdf in batches:
        least = pdf["id"].where(pdf["known"], np.iinfo(np.int64).max).groupby(pdf["h"]).transform("min")
        pdf["kind"] = np.where(~pdf["known"], NO_ID, np.where(pdf["id"] == least, LEAST, LATER)).astype("int32")
        pdf["id"] = pdf["id"].where(pdf["kind"] == LEAST, 0)
        keys = ["h", "part", "mask", "good", "toxic", "kind", "id"]
        copies = pdf["h"].duplicated(keep=False)
        once = pdf.loc[~copies, keys].assign(n=1)
        many = pdf[copies].groupby(keys, as_index=False, sort=False).size().rename(columns={"size": "n"})
        yield pd.concat([once, many]) if len(many) else once


COMBINED = "h string, part string, mask int, good int, toxic int, kind int, id long, n long"
CHANGES = "part string, mask int, good int, toxic int, n long"
CHANGE = Row("part", "mask", "good", "toxic", "n")


class LeastId(StatefulProcessor):
    """Per text: the smallest id so far and how its rows were counted; emits changes of the counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "id long, counted string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changes: Counter = Counter()
        firsts: dict[int, Counter] = {}
        for r in rows:
            entry = (r["part"], r["mask"], r["good"], r["toxic"])
            if r["kind"] == LEAST:
                firsts.setdefault(r["id"], Counter())[entry] += r["n"]
            else:
                changes[_marked(entry) if r["kind"] == LATER else entry] += r["n"]
        if firsts:
            held = self.held.get()
            before = None if held is None else held[0]
            least = min(firsts) if before is None else min(before, *firsts)
            counted: Counter = Counter()
            if held is not None and (least < before or least in firsts):
                counted = Counter({tuple(c[:4]): c[4] for c in json.loads(held[1])})
            if before is not None and least < before:
                for entry, n in counted.items():
                    changes[entry] -= n
                    changes[_marked(entry)] += n
                counted = Counter()
            for doc, entries in firsts.items():
                for entry, n in entries.items():
                    if doc == least:
                        counted[entry] += n
                        changes[entry] += n
                    else:
                        changes[_marked(entry)] += n
            if least in firsts:
                self.held.update((least, json.dumps([(*entry, n) for entry, n in counted.items()])))
        for entry, n in changes.items():
            if n:
                yield CHANGE(*entry, n)

    def close(self) -> None:
        pass


def _marked(entry: tuple) -> tuple:
    return entry[0], entry[1] | DUPLICATE, entry[2], entry[3]


def count_masks(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, mask, n, good, toxic) of all rows of the Parquet table at ``path``, mask 16 included."""
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // batches))
    # a pattern that matches the path alone: a table may be one file or a folder
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    marks = (labels.groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    read = stream.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_t"))
    own = with_mask(read.withColumn("h", F.sha2("_t", 256)), "_t")
    rows = (own.join(marks, own["_doc"] == marks["_id"], "left")
            .select("h", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
                    F.col("_doc").isNotNull().alias("known"), F.coalesce("_doc", F.lit(0).cast("long")).alias("id")))
    changes = rows.mapInPandas(_combine, COMBINED).groupBy("h").transformWithState(LeastId(), CHANGES, "Update", "None")
    place = common.shared_folder(spark, "audit")

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{place}/counters/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        query = (changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    if not table.limit(1).count():
        return spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    counters = spark.read.schema(CHANGES).parquet(f"{place}/counters/batch=*")
    return counters.groupBy("part", "mask").agg(*[F.sum(F.col("n") * w).alias(name) for name, w in (("n", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))])


def every_order(counters: DataFrame) -> DataFrame:
    """What each step of each of the 120 orders keeps, removes and loses, from (part, mask, n, good, toxic)."""
    size = 1 << len(FILTERS)

    def cells(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)).cast("long") for m in range(size)]).alias(f"_{name}")

    wide = counters.groupBy("part").agg(cells("n"), cells("good"), cells("toxic"))
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        steps += [(name, k + 1, 1 << f, sum(1 << i for i in order[:k])) for k, f in enumerate(order)]
    shape = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    table = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{a}","step":{b},"bit":{c},"before":{d}}}' for a, b, c, d in steps) + "]"), shape)
    rows = wide.withColumn("_s", F.explode(table)).select("*", "_s.*")
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    bit, before = F.col("bit"), F.col("before")

    def total(name: str, cond) -> Column:
        return F.aggregate(F.filter(masks, cond), F.lit(0).cast("long"), lambda acc, m: acc + F.element_at(f"_{name}", m + 1))

    def hit(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    orders = len(steps) // len(FILTERS)
    # a mask of k conditions is removed by each of them in the same number of orders
    shapley = F.aggregate(F.filter(masks, lambda m: m.bitwiseAND(bit) != 0), F.lit(0).cast("long"),
                          lambda acc, m: acc + F.element_at("_n", m + 1) * (F.lit(orders) / F.bit_count(m)).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", hit).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at("_n", bit + 1).alias("unique_fails"),
        total("good", hit).alias("good_lost"), total("toxic", hit).alias("toxic_lost"), shapley.alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """Audit of five filters over the Parquet table at ``path`` (doc_id, text, lang), read as a stream.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows
    per part, none for an empty table. A null text is empty, a null lang the part ''. Rows with a null id never count as
    duplicates and make no other row one; rows that repeat the least id of a text stay with it. Several labels of one id
    count as one that has what any of them has. Copies are told by SHA-256 of the whole text. Other columns are ignored.
    """
    return every_order(count_masks(spark, path, labels, batches))
