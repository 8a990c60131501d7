"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. The virtual finish time of one is the number
of its source's words up to its end, over all passes, divided by the source's target. Sorted by it, the
sources interleave in proportion, and since targets share the budget, the order reaches the budget at
virtual time 1: what starts later is not taken, and what is being read then is cut there.

The running sums are taken within hash buckets of a source and added to the totals of the buckets
before, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadtide.llm.common import column, fresh, saved, word_count


@dataclass(frozen=True)
class Mix:
    """Weights go around the sources in code point order, null last; ``share`` of all words is the
    budget; no source is read more than ``passes`` times. About ``bucket`` rows make a bucket."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    passes: int = 2
    bucket: int = 20_000
    seed: int = 17


def _key(source):
    """A string that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, conf: Mix) -> tuple[DataFrame, int]:
    """(``skey``, ``source_size``, ``target``) from (``skey``, ``source_size``, ``rows``), and all rows.

    The excess of sources above their limit goes to the others by weight until none is above: each
    round is one small aggregate, and the level only rises.
    """
    # One row per source, so this unpartitioned window is as long as the list of sources.
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in conf.weights)), (place % len(conf.weights) + 1).cast("int"))
    table = saved(sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * conf.passes), "sources")
    total, weights, rows = table.agg(F.sum("source_size"), F.sum("weight"), F.sum("rows")).first()
    budget = conf.share * (total or 0)
    level = budget / weights if weights else 0.0
    while True:
        above = F.col("limit") < F.col("weight") * level
        fixed, free = table.agg(F.sum(F.when(above, F.col("limit")).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - (fixed or 0)) / free if free else level
        if not new > level:
            break
        level = new
    target = F.least(F.col("limit").cast("double"), F.col("weight") * level)
    return table.select("skey", "source_size", target.alias("target")), rows or 0


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", conf: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``skey``, ``size``, ``source_size``, ``target``, ``before``.

    ``before`` is the number of words of its source ahead of it in the shuffled order. Null and empty
    texts have size 0 and take no room; equal ids and sizes are ordered arbitrarily, which changes no
    result; null ids come in the order of their sizes; an empty table gives none.
    """
    id_, source = column(docs, id_col).cast("long"), column(docs, source_col).cast("string")
    rows = docs.select(id_.alias("id"), _key(source).alias("skey"), word_count(column(docs, text_col)).alias("size"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(conf.seed), "id"))
    rows = saved(rows, "sizes")
    known, n = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), conf)
    buckets = max(1, math.ceil(n / conf.bucket))
    rows = rows.withColumn("bucket", F.pmod("turn", F.lit(buckets)))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("here")
    sums = sums.select("skey", "bucket", ahead.alias("ahead")).join(known, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(sums, ["skey", "bucket"])
    return rows.select("id", "skey", "size", "source_size", "target", (F.col("ahead") + F.col("upto") - F.col("size")).alias("before"), "turn")


def taken_in(n: int):
    """Words that pass ``n`` takes of a document."""
    served = F.floor("target") - F.col("before") - F.lit(n) * F.col("source_size")
    return F.greatest(F.lit(0), F.least(served, F.col("size"))).cast("long")


def taken(conf: Mix = Mix()):
    """Words taken of a document over all passes."""
    return sum((taken_in(n) for n in range(1, conf.passes)), taken_in(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", conf: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` in the order of their virtual finish time, repeated once per pass that takes
    them; a document cut at the end of the budget keeps its first words. Rows without words go.

    A null source is one of its own, last. Rows without an id are told apart by size, source and text, as are
    rows that repeat one; equal rows are each taken in their turn, and m such rows of one id, size and source
    are matched in m * m pairs. Equal finish times come in the order of ids. Texts are read whole, columns
    stay as they are, an empty table stays empty.
    """
    key, size, words, turn, finish, skey, nth, own = fresh(docs, "mix_key", "mix_size", "mix_words", "mix_turn", "mix_finish", "mix_source", "row_nth", "row_key")
    name = lambda i: F.coalesce(i.cast("long").cast("string"), F.lit("none"))
    plan = shares(docs, id_col, text_col, source_col, conf).where("target > 0 AND size > 0")
    passes = F.array(*(F.struct(taken_in(n).alias("words"), ((F.col("before") + F.col("size") + n * F.col("source_size")) / F.col("target")).alias("finish")) for n in range(conf.passes)))
    # Rows that repeat an id are told apart by their size and place in it.
    plan = plan.select(name(F.col("id")).alias(key), F.col("size").alias(size), F.col("skey").alias(skey), "before", passes.alias("passes"))
    plan = plan.withColumn(turn, F.row_number().over(Window.partitionBy(key, size, skey).orderBy("before")))
    plan = plan.select(key, size, skey, turn, F.explode("passes").alias("p")).where("p.words > 0").select(key, size, skey, turn, F.col("p.words").alias(words), F.col("p.finish").alias(finish))
    rows = docs.withColumns({own: name(column(docs, id_col)), size: word_count(column(docs, text_col)), skey: _key(column(docs, source_col).cast("string"))})
    rows = rows.where(F.col(size) > 0).withColumnRenamed(own, key)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, size, skey).orderBy(column(rows, text_col))))
    # As a difference the place is no join key, so the join takes the rows as the window left them.
    out = rows.alias("r").join(plan.alias("p"), [key, size, skey]).where(F.col(nth) - F.col(turn) == 0)
    # Possessive, so a long prefix neither backtracks nor recurses.
    first = F.regexp_substr(column(out, text_col), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col(words), F.lit("}+")))
    out = out.withColumn(text_col, F.when(F.col(words) < F.col(size), first).otherwise(column(out, text_col)))
    return out.repartitionByRange(finish, key).sortWithinPartitions(finish, key).select(*docs.columns)
