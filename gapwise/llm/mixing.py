"""Mixing sources to target weights, in DataFrame and SQL functions only.

Tokens are counted per cell (source, language, topic): one partial aggregate over the corpus.  Iterative
proportional fitting then rakes the cell weights: in turn the weights of each margin are scaled to that
margin's targets, until all three agree.  A document of a cell is drawn with the probability
``rate * weight of the cell / tokens of the cell``, scaled so that the scarcest cells are drawn whole
(``rate`` 1) or with a smaller rate; so the expected tokens of every cell follow its weight.  Whether a
document is drawn depends on a hash of its id and a seed: the draw is the same on every run and machine.

Nulls in a margin count as the value "" of that margin, a null text has no tokens, and a document without
tokens belongs to its cell but weighs nothing.  Rows that repeat are drawn together; a row without an id is
drawn by a hash of its text, and without both by that of an empty id.  An empty table gives an empty one.

The cells are at most the product of the margins' values.  They are fitted in one task as long as there
are ``CELLS_PER_TASK`` of them at most (counted), and by partitions of each margin beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch, mark_free, words_of

SWEEPS = 24
SWEEPS_PER_STEP = 4
CELLS_PER_TASK = 50_000
MARGINS = ("source", "lang", "topic")
#: Hash digits that decide a draw: a number below 16 ** 13, exact as a double.
DIGITS = 13
SEED = "mix-1"


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.size(words_of(text)).cast("long")


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic from the shape of the text: table, code or markup, note, article or book."""
    marks = F.length(text) - F.length(F.translate(text, "|{}<>#*$%&", ""))
    return (
        F.when(F.coalesce(marks, F.lit(0)) * 5 >= F.greatest(n_tokens, F.lit(1)), "markup")
        .when(n_tokens < 100, "note")
        .when(n_tokens < 1000, "article")
        .otherwise("book")
    )


def cells_of(docs: DataFrame) -> DataFrame:
    """Documents and tokens of every (source, language, topic); columns ``source lang topic n_tokens``."""
    return docs.groupBy(*MARGINS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets of a margin: its token shares to a power (0: equal shares, 1: as they are), then to a sum of 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    return sums.select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """The cells with ``weight``, which sums to 1 and meets the targets, and ``deviation``.

    ``targets``: per margin a table of its values and ``target`` (any positive scale).  A value without a
    target has the target 0; targets of values without tokens are left out and the rest is scaled up.
    ``deviation`` is the largest distance of a margin's share from its target.
    """
    table = cells
    for margin in MARGINS:
        table = table.join(targets[margin].select(margin, F.col("target").cast("double").alias(f"t_{margin}")), margin, "left")
    table = table.select(*cells.columns, *(F.coalesce(f"t_{m}", F.lit(0.0)).alias(f"t_{m}") for m in MARGINS))
    # A target counts once per value, though the value has many cells.
    table = scratch.put(table, "cells")
    for margin in MARGINS:
        total = table.select(margin, f"t_{margin}").distinct().agg(F.sum(f"t_{margin}")).first()[0] or 1.0
        table = table.withColumn(f"t_{margin}", F.col(f"t_{margin}") / total)
    small = table.limit(CELLS_PER_TASK + 1).count() <= CELLS_PER_TASK
    table = table.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))) if small else _shared(table)
    for step in range(0, SWEEPS, SWEEPS_PER_STEP):
        table = table.coalesce(1) if small else table
        for _ in range(SWEEPS_PER_STEP):
            for margin in MARGINS:
                share = F.sum("weight").over(Window.partitionBy(margin))
                table = table.withColumn("weight", F.when(share > 0, F.col("weight") * F.col(f"t_{margin}") / share).otherwise(0.0))
        table = scratch.put(table, "raked")
    off = [
        table.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"t_{m}").alias("t")).agg(F.max(F.abs(F.col("w") - F.col("t")))).first()[0] or 0.0
        for m in MARGINS
    ]
    return table.select(*cells.columns, "weight").withColumn("deviation", F.lit(float(max(off))))


def _shared(table: DataFrame) -> DataFrame:
    total = table.agg(F.sum("tokens")).first()[0]
    return table.withColumn("weight", F.col("tokens") / F.lit(total))


def draw(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from an id, or from the text where there is none."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), name))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def mixed(docs: DataFrame, *, power: dict[str, float], key: str = "doc_id", text: str = "text", rate: float = 1.0, seed: str = SEED) -> DataFrame:
    """The drawn rows, with all columns and ``topic``, ``n_tokens``, ``probability`` and ``cell_weight``.

    ``power``: per margin the exponent of ``tempered``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = {c: mark_free(docs, c) for c in ("topic", "n_tokens", "probability", "cell_weight")}
    own = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col(text).alias("text"),
    )
    counted = own.withColumn("n_tokens", tokens(F.col("text"))).withColumn("topic", topic(F.col("text"), F.col("n_tokens")))
    cells = scratch.put(cells_of(counted), "counts")
    fitted = rake(cells, {m: tempered(cells, m, power.get(m, 1.0)) for m in MARGINS}, scratch)
    ratio = fitted.select(*MARGINS, F.col("weight").alias("_w"), (F.col("weight") / F.col("tokens")).alias("_r"))
    top = ratio.agg(F.max("_r")).first()[0] or 1.0
    own_name = {c: mark_free(docs, f"_{c}") for c in ("n", "s", "l", "t", "source", "lang", "topic", "w", "p")}
    n, s, l, t, _source, _lang, _topic, w, p = own_name.values()
    ratio = ratio.select(*(F.col(m).alias(own_name[m]) for m in MARGINS), F.col("_w").alias(w), (F.lit(rate) * F.col("_r") / F.lit(top)).alias(p))
    rows = docs.withColumns({n: tokens(F.col(text)), s: F.coalesce(F.col("source").cast("string"), F.lit("")), l: F.coalesce(F.col("lang").cast("string"), F.lit(""))})
    rows = rows.withColumn(t, topic(F.col(text), F.col(n)))
    # Bounded by the product of the margins' values, which was counted above.
    ratio = F.broadcast(ratio) if cells.limit(CELLS_PER_TASK + 1).count() <= CELLS_PER_TASK else ratio
    rows = rows.join(ratio, (F.col(s) == F.col(_source)) & (F.col(l) == F.col(_lang)) & (F.col(t) == F.col(_topic)), "left")
    chance = F.coalesce(F.col(p), F.lit(0.0))
    rows = rows.where(draw(F.col(key), F.col(text), seed) < chance)
    return rows.select(
        *docs.columns,
        F.col(t).alias(names["topic"]),
        F.col(n).alias(names["n_tokens"]),
        chance.alias(names["probability"]),
        F.coalesce(F.col(w), F.lit(0.0)).alias(names["cell_weight"]),
    )
