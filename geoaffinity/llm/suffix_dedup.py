"""Repeated passages by a sparse suffix array.

Of every SPAN neighbouring starts of SEED-word seeds, the one of least hash (a minimiser) is selected;
the suffixes that begin there are retained. A passage of LENGTH words selects its suffix among its
first SPAN starts, the same one in every copy, so none is missed, and holds at least HEAD words from it on. A first pass
counts these heads; suffixes whose head occurs once in the corpus are dropped by a bitmap.

Each other suffix is a row: its words as far as the passages that selected it reach, then the words
before it as far back as they begin, nearest first. The rows are sorted by these words, then doc_id
and position, over as many partitions as Spark makes, and each is compared with its neighbour:

* All words equal: the match extends over all passages that selected the suffix, and the later row
  of the two is a repeat there. Long and frequent passages consist of such rows.
* Only the head equal: the match ends within reach, to the left or to the right, and rows that match
  further need not be neighbours. The first and last of each run of equal rows extend left and right
  word by word, from the one end of reach to the other: each LENGTH words on the way are grouped by
  their 128-bit digest, and each group's first is kept. So do the runs at a partition's borders, whose
  neighbours are in another task.

Overlapping matches of a document join into passages of any length. A passage's first occurrence is
kept, the others are repeats. Texts of equal words are one class: only its first document is
searched, its copies are repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, checkpointed, small_columns_of, stored, unused, words
from geoaffinity.llm.hashing import WordHashes, bitmap_of, digest, in_bitmap, long_rows, windows

#: Words of the shortest passage that counts, and of a seed; starts of which one is selected.
LENGTH, SEED, SPAN = 50, 8, 24
#: Words that passages with the same selected suffix share at least, from it on.
HEAD = LENGTH - SPAN + 1
#: Bytes of the longest word that is sorted as it is; longer ones are sorted by a digest.
WORD_BYTES = 64
#: Rows of a batch that a task sends on.
BATCH = 4000
#: A word ends, the words from the suffix on end: bytes that are in no word.
_NEXT, _BEFORE = b"\t", b"\n"
_SUFFIX = pa.schema(
    [("suffix", pa.binary()), ("doc", pa.int64()), ("pos", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
)
_COMPARED = pa.schema(
    [("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other", pa.int64()), ("key", pa.binary())]
)


def selected(found: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The positions selected in a text of LENGTH words or more, the first and the last start of the
    passages that selected each, and the hashes of their heads."""
    of_words = hashes.of(found)
    seeds = windows(of_words, SEED)
    # least seed of each window, leftmost of equals: doubling the width of what is compared
    best = np.arange(len(seeds))
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(seeds[right] < seeds[left], right, left)
        width += step
    best = best[: len(found) - LENGTH + 1]
    places, low, times = np.unique(best, return_index=True, return_counts=True)
    return places, low, low + times - 1, windows(of_words, HEAD)[places]


def sortable(word: bytes) -> bytes:
    """A word, or a digest of bounded length that is no word's."""
    return word if len(word) <= WORD_BYTES else b"\xff" + hashlib.md5(word, usedforsecurity=False).hexdigest().encode()


def bits_for(count: int) -> int:
    """Bits of a bitmap of so many values: some 16 for each, 2^20 to 2^27 (16 MB)."""
    return 1 << min(27, max(20, (16 * count - 1).bit_length()))


def word_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in small_columns_of(batches):
            found = [words(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([digest(w) for w in found], pa.binary()), pa.array([len(w) for w in found], pa.int64())],
                names=["doc_id", "digest", "n_words"],
            )

    return docs.mapInArrow(rows, "doc_id long, digest binary, n_words long")


def _first_texts(batches: Iterator[pa.RecordBatch], firsts: np.ndarray) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(doc, words) of the first documents' texts of LENGTH words or more, some at a time."""
    for ids, texts in small_columns_of(batches):
        first = in_bitmap(firsts, np.array(ids, np.int64))
        found = [(doc, words(text)) for doc, text, asked in zip(ids, texts, first, strict=True) if asked]
        if found := [(doc, w) for doc, w in found if len(w) >= LENGTH]:
            yield found


def suffix_heads(docs: DataFrame, firsts: np.ndarray) -> DataFrame:
    """(head, times): the hash of every retained suffix's head, counted in each task.

    firsts: a bitmap of the ids of first documents. A copy found in it by chance takes part too;
    its passages are repeats of the true first's, as its whole text is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(firsts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for texts in _first_texts(batches, shared.value):
            heads, times = np.unique(np.concatenate([selected(w, hashes)[3] for _, w in texts]), return_counts=True)
            yield from long_rows(["head", "times"], [heads.view(np.int64), times])

    return docs.mapInArrow(rows, "head long, times long")


def retained_suffixes(docs: DataFrame, firsts: np.ndarray, again: np.ndarray) -> DataFrame:
    """(suffix, doc, pos, low, high): the suffixes whose head may occur again.

    suffix: the words from pos to the end of the last passage that selected it, then those before
    pos to the start of the first, nearest first; low, high: the first and the last start of these passages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((firsts, again))

    def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, int, int]]:
        hashes = WordHashes()
        firsts, again = shared.value
        for texts in _first_texts(batches, firsts):
            for doc, found in texts:
                places, low, high, heads = selected(found, hashes)
                kept = in_bitmap(again, heads)
                for p, a, b in zip(places[kept].tolist(), low[kept].tolist(), high[kept].tolist(), strict=True):
                    ahead = _NEXT.join(map(sortable, found[p : b + LENGTH]))
                    yield ahead + _BEFORE + _NEXT.join(map(sortable, reversed(found[a:p]))), doc, p, a, b

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found_rows(batches), _SUFFIX)

    return docs.mapInArrow(rows, "suffix binary, doc long, pos long, low long, high long")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch_of(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield batch_of(schema, list(zip(*held, strict=True)))


def head_of(suffix: bytes) -> list[bytes]:
    return suffix[: suffix.index(_BEFORE)].split(_NEXT, HEAD)[:HEAD]


def extended(suffix: bytes, doc: int, low: int, high: int) -> Iterator[tuple]:
    """The passages of LENGTH words from the one end of a suffix's reach to the other, by digest."""
    ahead, before = suffix.split(_BEFORE)
    found = [*reversed(before.split(_NEXT) if before else []), *ahead.split(_NEXT)]
    for n in range(high - low + 1):
        yield doc, low + n, None, None, hashlib.md5(_NEXT.join(found[n : n + LENGTH]), usedforsecurity=False).digest()


def compare(rows: Iterator[tuple[bytes, int, int, int, int]]) -> Iterator[tuple]:
    """What comparing each of a partition's sorted suffixes with its neighbour finds, as rows (doc,
    start, end, other, key), one of

    * a repeat from start to end, with the first document of its run of equal suffixes; where the run may
      have begun in an earlier partition, key is its digest, and other the first document here;
    * a first occurrence: end is negated;
    * a partition's last run: doc null, key its digest, other its first document;
    * a passage to be grouped: end null, key its digest.

    One run's first and last suffix are held, whatever the run's length.
    """
    first = last = head = name = None
    opening = joined = True  # whether the run is the partition's first; whether the run before has its head

    def closed(ends_open: bool) -> Iterator[tuple]:
        _, doc, _, low, high = first
        if joined or ends_open:
            yield from extended(first[0], doc, low, high)
            if last is not first:
                yield from extended(last[0], last[1], last[3], last[4])
        elif last is not first:
            yield doc, low, -(high + LENGTH), last[1], None

    for row in rows:
        suffix, doc, pos, low, high = row
        if first is not None and suffix == first[0]:
            if (doc, pos) != last[1:3]:
                yield doc, low, high + LENGTH, first[1], name
                last = row
            continue
        following = head_of(suffix)
        if first is not None:
            same = following == head
            yield from closed(same)
            joined, opening = same, False
        first = last = row
        head = following
        name = hashlib.md5(suffix, usedforsecurity=False).digest() if opening else None
    if first is not None:
        yield from closed(True)
        yield None, None, None, first[1], hashlib.md5(first[0], usedforsecurity=False).digest()


def compared_neighbours(suffixes: DataFrame) -> DataFrame:
    """The sorted suffixes' rows of compare(). Rows of equal words are told apart by doc and pos, so
    a frequent passage's are dealt to many partitions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for columns in small_columns_of(batches) for row in zip(*columns, strict=True))
        yield from _batches(compare(found), _COMPARED)

    return suffixes.orderBy("suffix", "doc", "pos").mapInArrow(rows, "doc long, start long, end long, other long, key binary")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, repeat, other_id): the passages of docs (doc_id, text) that repeat.

    start, end: word positions, end exclusive. repeat: false where this is the first occurrence,
    true where it is a later one, in the order of doc_id and position; other_id: a document that
    holds a part of the passage too (an earlier one for a repeat; it may be the same document). A text that has
    copies is a first occurrence as a whole in its first document, also where an earlier document
    holds a part of it; so a first and a repeated passage of a document may overlap.

    Texts of fewer than LENGTH words, null and empty texts give no rows. Rows without doc_id take
    no part. Rows of the same doc_id and words count once; other rows of the same doc_id are
    examined each. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter(
        "doc_id is not null"
    )
    digests = checkpointed(word_digests(docs).filter(F.col("n_words") >= LENGTH).distinct())
    classes = checkpointed(
        digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    )
    whole = digests.join(classes, "digest").filter("last_id > first_id")
    whole = whole.select(
        F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"),
        (F.col("doc_id") > F.col("first_id")).alias("repeat"),
        F.when(F.col("doc_id") > F.col("first_id"), F.col("first_id")).otherwise(F.col("last_id")).alias("other"),
    )
    firsts = bitmap_of(classes, "first_id", bits_for(classes.count()))
    again = suffix_heads(docs, firsts).groupBy("head").agg(F.sum("times").alias("times"))
    again = checkpointed(again.filter("times > 1").select("head"))
    suffixes = stored(retained_suffixes(docs, firsts, bitmap_of(again, "head", bits_for(again.count()))))
    compared = stored(compared_neighbours(suffixes))
    # one row for each partition at most: the runs that may go on in the next one
    begun = compared.filter("key is not null and (doc is null or end is not null)")
    begun = begun.groupBy("key").agg(F.min("other").alias("first_other"))
    runs = compared.filter("end is not null").join(F.broadcast(begun), "key", "left")
    runs = runs.select(
        "doc", "start", F.abs("end").alias("end"), (F.col("end") > 0).alias("repeat"),
        F.coalesce("first_other", "other").alias("other"),
    )
    around = compared.filter("end is null and doc is not null").select("key", "doc", "start")
    groups = around.groupBy("key").agg(
        F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")
    )
    groups = groups.filter(F.col("first") != F.col("last"))
    matched = around.join(groups, "key").select(
        "doc", "start", (F.col("start") + LENGTH).alias("end"),
        (F.struct("doc", "start") != F.col("first")).alias("repeat"),
        F.when(F.struct("doc", "start") != F.col("first"), F.col("first.doc")).otherwise(F.col("last.doc")).alias("other"),
    )
    spans = whole.union(runs).union(matched)
    in_order = Window.partitionBy("doc", "repeat").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    passages = (
        spans.withColumn("new", (F.coalesce(F.col("start") > reach, F.lit(True))).cast("long"))
        .withColumn("nth", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "repeat", "nth")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other_id"))
    )
    return passages.select(
        F.col("doc").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "repeat", "other_id"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the words of repeats cut out of their texts; other columns as they are.

    Texts without repeats stay as they are, to the byte; cut texts are their remaining words with
    the white space that follows each. A row of which nothing remains goes. If there is a column
    n_chars it gets the length of the new text.
    """
    names = docs.columns
    cut_id, cuts, is_cut = unused(["cut_id", "cuts", "is_cut"], names)
    spans = (
        repeated_passages(docs)
        .filter("repeat")
        .groupBy(F.col("doc_id").alias(cut_id))
        .agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    )
    joined = docs.join(spans, docs["doc_id"].cast("long") == F.col(cut_id), "left")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        import pandas as pd

        return pd.Series([remaining(t, c) for t, c in zip(texts, cuts, strict=True)])

    # else Spark would repeat it in the filter below, in Python workers of its own
    cut = cut.asNondeterministic()
    changed = F.when(F.col(cuts).isNull(), docs["text"]).otherwise(cut(docs["text"].cast("string"), F.col(cuts)))
    out = joined.select(*[changed.alias(c) if c == "text" else docs[c] for c in names], F.col(cuts).isNotNull().alias(is_cut))
    if "n_chars" in names:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(is_cut), size).otherwise(F.col("n_chars")))
    return out.filter(~F.col(is_cut) | (F.length("text") > 0)).select(*names)


def remaining(text: str | None, cuts: object) -> str | None:
    """A text without the words of some spans of word positions."""
    import re

    if text is None or cuts is None:
        return text
    kept, at = [], 0
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for cut in sorted((min(c["start"], len(places)), min(c["end"], len(places))) for c in cuts):
        if cut[1] <= at:
            continue
        start = max(cut[0], at)
        if start > at:
            kept.append(text[places[at][0] : places[start][0]])
        at = cut[1]
    if at < len(places):
        kept.append(text[places[at][0] :])
    return "".join(kept)
