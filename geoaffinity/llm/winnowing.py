"""Document fingerprints by winnowing; DataFrame functions only.

A text of n code points has a hash for each run of `gram` code points. Of every `window`
consecutive hashes the least is chosen, of equal ones the rightmost; the places so chosen and
their hashes are the fingerprint. Any passage of gram + window - 1 code points that two texts share
contains a whole window, so both choose the same place in it and share a hash.

All windows of a stretch of text are minimised together: the minima over d and over d more places
give those over 2 d, so a window takes the logarithm of its length in array operations. Long texts
go through in pieces that overlap by a window, so that only the chosen places of a text are held
besides the text. Texts are taken apart as UTF-32, where any place is found at once.

The next document in the order of doc_id comes from a window over buckets of neighbouring ids. A
bucket's least id is known beforehand, so its row is also sent to the bucket before, and no bucket
needs to look into another. Texts are shuffled once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 32
#: Windows that are minimised together; with one more their bytes are counted in the low bits of a rank.
PIECE = 4096
_PLACE_BITS = 15
#: Rows of a bucket and of a task, and most buckets and tasks (rows grow beyond).
BUCKET_ROWS, TASK_ROWS = 64, 2000
MOST_BUCKETS, MOST_TASKS = 100_000, 50_000
#: Ids sampled for each bucket, so that buckets are even.
_SAMPLED = 8


def let(value: Column, use) -> Column:
    """use(value), with the value computed and held once however often it is used."""
    return F.transform(F.array(value), use)[0]


def points(text: Column) -> Column:
    """Four bytes for each code point."""
    return F.encode(text, "UTF-32")


def gram_hash(utf32: Column, place: Column, gram: int) -> Column:
    """The hash of the code points from a place (from 0) on."""
    return F.xxhash64(F.substring(utf32, place * 4 + 1, F.lit(4 * gram)))


def window_count(n_chars: Column, gram: int, window: int) -> Column:
    """Windows of a text: one for a short text, none for an empty one."""
    return F.when(n_chars > 0, F.greatest(n_chars - (gram + window - 2), F.lit(1))).otherwise(0)


def sliding_minima(ranks: Column, window: int) -> Column:
    """For each place of an array the least of the window that begins there or of what is left of it."""
    steps, reach = [], 1
    while reach < window:
        steps.append(min(reach, window - reach))
        reach += steps[-1]
    if not steps:
        return ranks

    def least(m: Column, step: Column) -> Column:
        return F.zip_with(m, F.slice(m, step + 1, F.size(m)), lambda a, b: F.least(a, b))

    return F.aggregate(F.array(*map(F.lit, steps)), ranks, least)


def chosen_places(text: Column, n_chars: Column, first: Column, end: Column, gram: int, window: int) -> Column:
    """Places chosen by the windows that begin at first and before end, ascending."""
    low = F.lit((1 << _PLACE_BITS) - 1)
    grams = F.greatest(n_chars - (gram - 1), F.lit(1))

    def of_piece(utf32: Column, start: Column) -> Column:
        windows = F.least(F.lit(PIECE), end - start)
        hashes = F.least(windows + (window - 1), grams - start)

        def ranks(piece: Column) -> Column:
            """The hashes, with low bits that are less the more to the right, by byte from 1 on."""
            return F.transform(
                F.sequence(F.lit(1), hashes * 4, F.lit(4)),
                lambda byte: F.xxhash64(F.substring(piece, byte, F.lit(4 * gram))).bitwiseOR(low).bitwiseXOR(byte),
            )

        of_bytes = let(F.substring(utf32, start * 4 + 1, (hashes + (gram - 1)) * 4), ranks)
        chosen = F.array_distinct(F.slice(sliding_minima(of_bytes, window), F.lit(1), windows))
        return F.transform(
            chosen, lambda rank: start + F.shiftright(low - rank.bitwiseAND(low), 2).cast("int")
        )

    def of_text(utf32: Column) -> Column:
        starts = F.sequence(first, end - 1, F.lit(PIECE))
        return F.array_distinct(F.flatten(F.transform(starts, lambda start: of_piece(utf32, start))))

    return F.when(end > first, let(points(text), of_text)).otherwise(F.array().cast("array<int>"))


def place_hashes(text: Column, places: Column, gram: int) -> Column:
    """The hashes of the chosen places, in their order."""
    return let(points(text), lambda utf32: F.transform(places, lambda place: gram_hash(utf32, place, gram)))


def likeness(hashes: Column, others: Column) -> Column:
    """Share of the hashes of either fingerprint that both have; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(hashes, others)), F.size(F.array_union(hashes, others))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def written(places: Column, hashes: Column) -> Column:
    """A fingerprint as text: place:hash (hexadecimal), separated by spaces."""
    entries = F.zip_with(places, hashes, lambda place, h: F.concat(place.cast("string"), F.lit(":"), F.hex(h)))
    return F.array_join(entries, " ")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_chars, places, hashes), one for each row of docs (doc_id, text).

    A null text is empty, an empty one has no places, one shorter than a gram is hashed whole.
    Repeated rows and null doc_ids are kept. Other columns are not read.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("int")
    )
    n = F.col("n_chars")
    places = chosen_places(F.col("text"), n, F.lit(0), window_count(n, gram, window), gram, window)
    rows = rows.withColumn("places", places)
    return rows.select("doc_id", "n_chars", "places", place_hashes(F.col("text"), F.col("places"), gram).alias("hashes"))


def id_bounds(ids: DataFrame, rows: int) -> list[int]:
    """The least doc_id of every bucket, ascending; the first is the least of all."""
    spacing = max(BUCKET_ROWS, math.ceil(rows / MOST_BUCKETS))
    least = ids.agg(F.min("doc_id")).first()[0]
    if least is None:
        return []
    sampled = (
        ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, spacing // _SAMPLED))) == 0)
        .filter(F.col("doc_id").isNotNull())
        .distinct()
    )
    found = sorted(row[0] for row in sampled.collect())
    return sorted({least, *found[_SAMPLED::_SAMPLED]})


def with_buckets(rows: DataFrame, bounds: list[int], tasks: int) -> DataFrame:
    """Add bucket, wrap and guest; the first rows of buckets come twice, as guests of the bucket before.

    The first row of all is the guest of the last bucket, where wrap puts it behind the others.
    Rows without id follow no order and are dealt evenly to buckets below 0.
    """
    listed = F.split(F.lit(",".join(map(str, bounds)) or "0"), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]

    def jump(place: Column, step: Column) -> Column:
        there = place + step
        return F.when((there <= len(bounds)) & (F.try_element_at(listed, there) <= F.col("doc_id")), there).otherwise(place)

    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), jump)
    spread = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(tasks)).cast("int")
    rows = rows.withColumn("at", F.when(F.col("doc_id").isNull(), spread).otherwise(at))

    def place(bucket: Column, wrap: Column, guest: bool) -> Column:
        return F.struct(bucket.alias("bucket"), wrap.cast("int").alias("wrap"), F.lit(guest).alias("guest"))

    own = place(F.col("at"), F.lit(0), False)
    first = F.col("at") == 1
    before = place(F.when(first, F.lit(len(bounds))).otherwise(F.col("at") - 1), first, True)
    leads = (F.col("at") > 0) & (F.try_element_at(listed, F.greatest("at", F.lit(1))) == F.col("doc_id"))
    places = F.when(leads, F.array(own, before)).otherwise(F.array(own))
    return rows.withColumn("put", F.explode(places)).select("doc_id", "text", "put.*")


def fingerprint_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): its fingerprint and that of its edited text.

    In the edited text the last quarter of the code points (rounded down) is replaced by as many of
    the beginning of the next document, or all of it if it is shorter. The next document is the next
    row by doc_id and text, after the last the first; a table of one row follows itself. Rows
    without doc_id have no next document: their last quarter is replaced by nothing and near_next
    is null. A null text is empty; two empty fingerprints are alike (1). Repeated rows are kept,
    other columns not read. An empty table gives an empty result.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Windows within the part that an edit keeps choose the same places in both texts and
    are minimised once.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    total = rows.count()
    tasks = max(1, min(MOST_TASKS, math.ceil(total / TASK_ROWS)))
    rows = with_buckets(rows, id_bounds(rows.select("doc_id"), total), tasks).repartition(tasks, "bucket")

    n, m, kept = F.col("n_chars"), F.col("edited_chars"), F.col("kept")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("int"))
    rows = rows.withColumn("kept", n - F.floor(n / 4).cast("int")).withColumn(
        "common", F.greatest(kept - (gram + window - 2), F.lit(0))
    )
    common, body = F.col("common"), F.col("text")
    rows = rows.withColumn("shared", chosen_places(body, n, F.lit(0), common, gram, window))
    rest = chosen_places(body, n, common, window_count(n, gram, window), gram, window)
    rows = rows.withColumn("places", F.array_distinct(F.concat("shared", rest)))
    rows = rows.withColumn("hashes", place_hashes(body, F.col("places"), gram))

    following = Window.partitionBy("bucket").orderBy("wrap", "doc_id", "text")
    has_id = F.col("doc_id").isNotNull()
    rows = rows.select(
        "*",
        F.when(has_id, F.lead("text").over(following)).alias("next_text"),
        F.when(has_id, F.lead("hashes").over(following)).alias("next_hashes"),
    ).filter(~F.col("guest"))
    start = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), n - kept)
    rows = rows.withColumn("edited", F.concat(F.substring(body, F.lit(1), kept), start))
    rows = rows.withColumn("edited_chars", F.char_length("edited").cast("int"))
    edited = F.col("edited")
    rest = chosen_places(edited, m, common, window_count(m, gram, window), gram, window)
    rows = rows.withColumn("edited_places", F.array_distinct(F.concat("shared", rest)))
    rows = rows.withColumn("edited_hashes", place_hashes(edited, F.col("edited_places"), gram))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        written(F.col("places"), F.col("hashes")).alias("fingerprint"),
        written(F.col("edited_places"), F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        F.when(has_id, likeness(F.col("hashes"), F.col("next_hashes"))).alias("near_next"),
    )
