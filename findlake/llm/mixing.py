"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. Complete epochs come first: as many whole copies of the source as fit in its budget. What
is left of it goes to a weighted sample without replacement: a document's key is an exponential variate divided by its quality
weight, documents are sorted by key within their source, and their sizes are summed up until the budget is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.ranges import running_totals
from findlake.llm.storage import materialize

#: What ends a word: blanks, tabs and line ends of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: No document's weight is below this, so that each can be drawn.
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that are no white space, times the share of different lines; LEAST_WEIGHT or more.

    Texts of repeated lines, digits or signs weigh little; null and empty ones as little as can be.
    """
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    lines = F.split(text, "\n", -1)
    share = letters / F.nullif(shown, F.lit(0)) * F.size(F.array_distinct(lines)) / F.size(lines)
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(share, F.lit(0.0)))


def uniform(seed: str, *columns: Column) -> Column:
    """A number between 0 and 1 that follows from ``seed`` and the columns (null differs from empty): 52 bits of their md5."""
    values = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *values)), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` of ``sizes`` (source, source_size; a row a source).

    Sources by code point, null last, weigh ``weights`` in turn, and share ``share`` times the sum of all sizes by weight. No target
    is above ``most`` times its source's size: what is in excess goes to the others by weight, until none is above. Rounds of
    one aggregate each; their number is that of the steps in which sources reach their bound. Sources of size 0 have target 0.
    """
    if share > most:
        raise ValueError("the targets can't reach the share asked for")
    ranked = running_totals(sizes.withColumn("__last", F.col("source").isNull()).withColumn("__all", F.lit(0)), ["__all"], ["__last", "source"], F.lit(1), "__place", "__sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("__weight"), (F.col("source_size") * F.lit(float(most))).alias("__most")), "sources")
    whole = (table.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, bounded = 0.0, F.lit(False)
    while True:
        held, weighing = table.agg(F.sum(F.when(bounded, F.col("__most"))), F.sum(F.when(~bounded, F.col("__weight")))).first()
        if not weighing:
            break
        level = (whole - (held or 0.0)) / weighing
        above = F.lit(level) * F.col("__weight") > F.col("__most")
        if table.where(above & ~bounded).isEmpty():
            break
        # a level never falls from one round to the next: what has been bounded stays so
        bounded = above
    target = F.when(bounded, F.col("__most")).otherwise(F.lit(level) * F.col("__weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, targets: DataFrame, seed: str = "mix", cut_last: bool = True) -> DataFrame:
    """``docs`` (doc_id, source, size, weight, tie) with source_size, target, epochs and ``taken``: the words the mix takes of each.

    ``targets``: source, source_size, target (a row a source, null is one). A document is taken ``epochs`` times whole, and once
    more if its source's remaining budget, rounded to whole words, reaches it in the order of the keys. With ``cut_last`` the
    document at the border gives as many of its first words as are left, so a source's words are its target's; without it that document is
    taken whole or not, whichever comes nearer. ``tie`` tells rows of one doc_id apart; rows equal in all share a key and follow
    one another. Documents without words take part and give nothing. Keys follow from doc_id, tie and seed alone: reruns agree.
    """
    key = -F.log(uniform(seed, F.col("doc_id"), F.col("tie"))) / F.col("weight")
    keyed = docs.withColumn("__key", key)
    summed = running_totals(keyed, ["source"], ["__key", "doc_id", "tie"], F.col("size"), "__before", "source_size")
    wanted = targets.select(F.col("source").alias("__source"), "target")
    joined = summed.join(wanted, F.col("source").eqNullSafe(F.col("__source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    room = F.greatest(F.lit(0), F.col("__left") - F.col("__before"))
    part = F.least(F.col("size"), room) if cut_last else F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0)
    out = joined.withColumn("epochs", epochs.cast("long")).withColumn("__left", left)
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("__source", "__key", "__before", "__left")


def mix_documents(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: str = "mix", cut_last: bool = True) -> DataFrame:
    """Mix documents by the sources they name: doc_id, source, size, weight, source_size, target, epochs, taken.

    Sizes are words. Nulls: a null text has no words, null sources are one source, a null doc_id is a value like any other. Rows that
    repeat a doc_id are documents of their own. Extra columns play no part. An empty table gives none.
    """
    text = F.col("text")
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), quality_weight(text).alias("weight"), F.md5(text).alias("tie")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mix(slim, source_targets(sizes, weights, share, most), seed, cut_last).select("doc_id", "source", "size", "weight", "source_size", "target", "epochs", "taken")
