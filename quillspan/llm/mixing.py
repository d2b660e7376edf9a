"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the budget, clamped at ``max_epochs`` times its size; what
clamped sources leave is shared among the others by weight until none is above its clamp. The
fixed point is read off the sources sorted by (cap / weight): a prefix of them is clamped.

A target of e epochs takes each document floor(e) times and, in the order of a seeded digest, the
documents that fill the fraction; the document at the edge gives its first words only, so a source's
words differ from its target by less than one word.

Null and empty texts have size 0 and are never taken; null is a source of its own, last in order. Rows
with equal ids are kept and ordered by their text's digest; equal rows share what one of them takes.
An empty table gives an empty result. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST_BROADCAST = 50_000  # sources, a row each; beyond them documents and buckets are joined by shuffles


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """Targets of ``sources`` (source, weight long, source_size long): budget is a fraction of all sizes.

    Sums are of whole numbers, so the result is the same in any order. Sources with no words or no
    weight get 0. The windows are over one row a source.
    """
    num, den = budget
    live = sources.filter("source_size > 0 and weight > 0").withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        live.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("above", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(rest))
        # clamped: its share of what is left reaches its cap
        .withColumn("left", F.col("total") * num - F.col("above") * den)
        .withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("share") * den)
        .withColumn("c", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("w", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(1)))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * (F.col("total") * num - F.col("c") * den).cast("double") / (F.col("w") * den).cast("double")))
    )
    out = filled.select(F.col("source").alias("o_source"), F.least("target", F.col("cap").cast("double")).alias("target"))
    return sources.join(out, F.col("source").eqNullSafe(F.col("o_source")), "left").select("source", "weight", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: list[int], budget: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: str = "mix", buckets: int = 4096, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken and, to ``carry`` it, the whole row as __row.

    ``weights`` are dealt to the sources in code point order, again and again. Documents of one source are
    never gathered: their sizes are summed by (source, bucket of the digest), and only the bucket in
    which the fraction ends is ordered.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    whole = ["__row"] if carry else []
    docs = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    sized = scratch.keep(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("key"), *whole)
        .withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % buckets).cast("int")),
        "sized",
    )
    parts = scratch.keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("size").alias("most")), "parts")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", F.element_at(dealt, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    targets = scratch.keep(water_fill(sources, budget, max_epochs), "targets")

    # what is taken beyond whole epochs, in words
    part = F.greatest(F.floor(F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size") + F.lit(0.5)), F.lit(0)).cast("long")
    epochs = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("part", F.when(F.col("source_size") > 0, part).otherwise(0).cast("long"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b, t = parts.alias("b"), epochs.alias("t")
    edges = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "words", "source_size", "target", "whole", "part").withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edges = edges.withColumn("room", F.greatest(F.least(F.col("part") - F.col("before"), F.col("words")), F.lit(0)))
    inside = Window.partitionBy("e_source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    if targets.count() <= MOST_BROADCAST:
        # a source's buckets are taken whole up to one, and one more in part: one row a source says it
        room, whole_one = F.col("room") > 0, F.col("room") == F.col("words")
        ends = edges.groupBy("source", "source_size", "target", "whole").agg(
            F.max(F.when(room & whole_one, F.col("bucket"))).alias("full_to"), F.max(F.when(room & ~whole_one, F.col("bucket"))).alias("cut_at"), F.max(F.when(room & ~whole_one, F.col("room"))).alias("cut_room")
        )
        ends = scratch.keep(ends.withColumnRenamed("source", "e_source"), "ends")
        joined = sized.join(F.broadcast(ends), sized["source"].eqNullSafe(ends["e_source"]))
        is_cut, is_full, room_there = F.col("bucket").eqNullSafe(F.col("cut_at")), F.col("bucket") <= F.col("full_to"), F.col("cut_room")
    else:
        edges = scratch.keep(edges.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "words", "source_size", "target", "whole", "room"), "edges")
        joined = sized.join(edges.hint("merge"), sized["source"].eqNullSafe(edges["e_source"]) & (sized["bucket"] == edges["e_bucket"]))
        is_cut, is_full, room_there = (F.col("room") > 0) & (F.col("room") < F.col("words")), F.col("room") > 0, F.col("room")
    plain = joined.filter(~is_cut).withColumn("extra", F.when(is_full, F.col("size")).otherwise(F.lit(0)).cast("long"))
    cut = joined.filter(is_cut).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("extra", F.greatest(F.least(room_there - F.col("before"), F.col("size")), F.lit(0)).cast("long")).drop("before")
    return plain.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *whole)


def repeated(docs: DataFrame, weights: list[int], **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it is taken, and copy_no (from 1).

    A last copy that is taken in part holds its first words, with single spaces.
    """
    columns = docs.columns
    taken = mix(docs, weights, carry=True, **options).filter("taken > 0")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    text = F.col("__row.text")
    text = F.when(left >= F.col("size"), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, left.cast("int")), " "))
    copies = copies.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return copies.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in columns], F.col("__copy").alias("copy_no"))
