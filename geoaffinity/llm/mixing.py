"""Mixing sources to target weights, in blocks of words; DataFrame functions only.

The words of each source are laid end to end and cut into blocks of fixed length: BLOCK_WORDS, or
less for a source so small that it would have fewer than FEWEST_BLOCKS. The mix is a row of slots, each holding one block, in output shards of fixed size. Each shard draws how many of
its slots go to each source: slot j of a shard of k draws a uniform number from [j/k, (j+1)/k) and
takes the source in whose share it falls. These are multinomial counts with stratified draws, so
that a source's total strays from its target by a few blocks, not by their square root. A source's
n-th slot takes the block that a pseudorandom permutation of the source's blocks puts n-th; when
all blocks are taken a second permutation follows. Slots join blocks by index.

Every random number is a hash of the seed and of fixed positions, so reruns agree. Positions are
found by prefix sums in two levels (buckets of documents, chunks of shards), so no task orders the
whole of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaffinity.llm.frames import checkpointed, unused

#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and of a source at most this multiple.
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 32
#: Blocks that a source is cut into at least, if it has as many words.
FEWEST_BLOCKS = 64
SHARD_SLOTS = 1024
#: Slots that a task lays out.
_TASK_SLOTS = 200_000
#: Rounds of the permutation.
ROUNDS = 16
_BUCKET_ROWS = 1000
_CHUNK_SHARDS = 512


def uniform(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 to n-1 sends the index.

    Swap or not: in each round an index and its mirror image about a keyed point either change
    places or stay, as a keyed hash of the larger of the two says. Each round is a permutation.
    """

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        stays = F.xxhash64(F.greatest(x, mirror), r, *key).bitwiseAND(F.lit(1)) == 0
        return F.when(stays, x).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The sources of sizes (source, size): rank, source_size, target, block length and share of the slots.

    Sources above MOST times their size are held there and the excess goes to the others by
    weight, until none is above. Filling sources in the order of size over weight reaches the same
    level in one pass: the first source that the current level does not fill ends it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("rank", F.row_number().over(by_name).cast("long") - 1).withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")),
    )
    levels = ranked.withColumn("room", MOST * F.col("source_size") / F.col("weight")).withColumn(
        "level",
        (
            SHARE * F.sum("source_size").over(everything)
            - F.coalesce(F.sum(MOST * F.col("source_size")).over(by_room), F.lit(0.0))
        )
        / (
            F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(by_room), F.lit(0))
        ),
    )
    first = F.min(
        F.when(F.col("level") <= F.col("room"), F.struct("room", "rank", "level"))
    ).over(everything)
    targets = levels.withColumn(
        "target",
        F.least(MOST * F.col("source_size"), F.coalesce(first["level"], F.lit(math.inf)) * F.col("weight")),
    )
    length = F.greatest(F.least(F.floor(F.col("source_size") / FEWEST_BLOCKS), F.lit(block_words)), F.lit(1))
    targets = targets.withColumn("block_words", length.cast("long")).withColumn(
        "wanted", F.col("target") / F.col("block_words")
    )
    below = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    slots = F.sum("wanted").over(everything)
    return targets.select(
        "source", "rank", "source_size", "target", "block_words",
        F.coalesce(F.try_divide(F.sum("wanted").over(below), slots), F.lit(0.0)).alias("low"),
        F.coalesce(F.try_divide(F.sum("wanted").over(through), slots), F.lit(0.0)).alias("high"),
        slots.alias("slots"),
    )


def shard_counts(sources: DataFrame, slots: int, seed: int) -> DataFrame:
    """Rows (rank, shard, start, taken): how many slots of each shard fall to each source.

    start: slots of the source in the shards before.
    """
    shards = math.ceil(slots / SHARD_SLOTS)
    chunks = math.ceil(shards / _CHUNK_SHARDS)
    shard_slots = F.least(F.lit(SHARD_SLOTS), F.lit(slots) - F.col("shard") * SHARD_SLOTS)

    def draws_below(share: str) -> Column:
        point = F.col(share) * shard_slots
        stratum = F.floor(point)
        drawn = uniform(F.lit(seed), F.col("shard"), stratum) < point - stratum
        return F.when(F.col(share) >= 1 - 1e-12, shard_slots).otherwise(
            F.least(stratum + drawn.cast("long"), shard_slots)
        )

    counts = (
        sources.filter(F.col("high") > F.col("low"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .repartition("rank", "chunk")
        .withColumn(
            "shard",
            F.explode(
                F.sequence(
                    F.col("chunk").cast("long") * _CHUNK_SHARDS,
                    F.least((F.col("chunk").cast("long") + 1) * _CHUNK_SHARDS, F.lit(shards)) - 1,
                )
            ),
        )
        .withColumn("taken", draws_below("high") - draws_below("low"))
    )
    chunk_starts = counts.groupBy("rank", "chunk").agg(F.sum("taken").alias("in_chunk"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_starts = chunk_starts.select(
        "rank", "chunk", F.coalesce(F.sum("in_chunk").over(before), F.lit(0)).alias("chunk_start")
    )
    inside = Window.partitionBy("rank", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(chunk_starts, ["rank", "chunk"]).select(
        "rank", "shard", "taken", "source_size", "block_words",
        (F.col("chunk_start") + F.coalesce(F.sum("taken").over(inside), F.lit(0))).alias("start"),
    )


def block_takes(counts: DataFrame, slots: int, seed: int) -> DataFrame:
    """Rows (rank, block, times): how often the mix takes each block of each source.

    A block is taken MOST times at most: slots beyond find their source used up and stay empty.
    Shards are dealt to tasks before their slots are laid out.
    """
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    slot = (
        counts.filter(F.col("taken") > 0)
        .repartition(max(1, math.ceil(slots / _TASK_SLOTS)), "rank", "shard")
        .withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("taken") - 1)))
        .withColumn("blocks", blocks)
        .withColumn("round", F.floor(F.col("slot") / F.col("blocks")))
        .filter(F.col("round") < int(MOST))
    )
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("round"))
    return slot.select("rank", block.alias("block")).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, source): size, source_size, target, taken.

    size: words of the text (null and empty: none). target: of its source. taken: words that the
    mix takes from this row, repeats counted; at most MOST times its size. A null source is a
    source of its own, the last. Null doc_ids and repeated rows are kept, each row with its own
    words; rows are placed by doc_id and text, and only rows equal in both are taken as they come.
    Other columns are not read. Without any words all targets and takes are 0; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    sizes = checkpointed(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("mark"),
        )
    )
    rows = sizes.count()
    buckets = max(1, math.ceil(rows / _BUCKET_ROWS))
    # by text too: rows without doc_id, or of one doc_id, are no bucket of their own
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    in_buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    sources = checkpointed(source_targets(in_buckets, block_words))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_starts = (
        in_buckets.alias("b")
        .join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .select(
            F.col("b.source").alias("of_source"), F.col("b.bucket").alias("of_bucket"), "s.rank",
            "s.source_size", "s.target", "s.block_words",
            F.coalesce(F.sum("b.size").over(before), F.lit(0)).alias("bucket_start"),
        )
    )
    inside = (
        Window.partitionBy("rank", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sizes.join(
        bucket_starts,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")),
    ).select(
        "doc_id", "rank", "size", "source_size", "target", "block_words",
        (F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"),
        F.row_number().over(Window.partitionBy("rank", "bucket").orderBy("doc_id", "mark")).alias("nth"),
        "bucket",
    )
    slots = round(sources.agg(F.max("slots")).first()[0] or 0.0)
    if slots == 0:
        return placed.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    takes = block_takes(shard_counts(sources, slots, seed), slots, seed)
    end, length = F.col("start") + F.col("size"), F.col("block_words")
    pieces = placed.withColumn(
        "block",
        F.explode_outer(
            F.when(
                F.col("size") > 0,
                F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length)),
            )
        ),
    ).withColumn(
        "words",
        F.least(end, (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length),
    )
    row = ["doc_id", "rank", "bucket", "nth", "size", "source_size", "target"]
    return (
        pieces.select(*row, "block", "words")
        # never broadcast: Spark's estimate of the blocks does not see how far shards are laid out
        .join(takes.hint("merge"), ["rank", "block"], "left")
        .groupBy(*row)
        .agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The rows of docs that the mix holds, repeated as often as it takes them.

    A document is there taken / size times, rounded down or up by a hash of its doc_id so that the
    words kept come near the words taken. Documents without words, which no block holds, go.
    """
    of_doc, of_size, times, nth = unused(["of_doc", "of_size", "times", "nth"], docs.columns)
    takes = mix_sources(docs, block_words, seed).filter(F.col("taken") > 0)
    rounded = F.floor(F.col("taken") / F.col("size") + uniform(F.lit(seed), F.col("doc_id"), F.lit("copies")))
    copies = (
        takes.select(F.col("doc_id").alias(of_doc), F.col("size").alias(of_size), rounded.alias(times))
        .groupBy(of_doc, of_size)
        .agg(F.max(times).alias(times))
        .filter(F.col(times) > 0)
    )
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return (
        docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col(of_doc)) & (size == F.col(of_size)))
        .withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
