"""Documents whose sets of word 5-grams are alike, by adaptive multi-match prefixes.

Shingles are put in one order, rare ones first. Sets x and y of Jaccard similarity 0.8 share at
least 0.8 of either. So, for any m, the first n - ceil(0.8 n) + m shingles of both (their
m-prefixes) share m shingles at least. A longer prefix costs more index rows, but asks for more
shared shingles before a pair is verified. Each document takes the m of least estimated cost; a
pair is judged by the smaller m of the two.

The order needs document frequencies. These are counted over all documents in a table of fixed
size (a count sketch of one row), which only the speed of the join depends on.

Groups of copies are never expanded into pairs. Texts of the same words are one class. Then each
document is paired with one leader at most, that of its shared prefix shingles which most often
stands first in a prefix; verified pairs form first components. All remaining candidates, between
documents of different components, follow exactly: a shingle whose documents are all in one
component has none, and elsewhere only documents outside the largest component are paired. A pair
is left out only if it is proved not to be alike, by positions (of the shingles before a shared one
only those that occur in a second prefix can be common) or by signatures (parities of 256 buckets:
two sets differ in as many shingles as their signatures differ in bits, at least).

Texts are read twice: for frequencies, and for prefixes, which are written once, a row for each
document; candidates' texts are read again to verify them. Signatures stay in a row for each document
and meet pairs, or the rows of shingles that are still open, only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, checkpointed, columns_of, small_columns_of, stored, unused, words
from geoaffinity.llm.hashing import WordHashes, bitmap_of, digest, in_bitmap, long_rows, mixed, windows
from geoaffinity.llm.links import components

WINDOW = 5
#: Buckets of the frequency table.
COUNT_BITS = 20
#: The largest number of shared shingles that a prefix asks for, and the cost of verifying a pair
#: in index rows.
MOST_MATCHES = 4
VERIFY_COST = 20
#: Bits of the bitmap of shingles that occur again: 16 for each, within these bounds (2 and 16 MB).
#: Beyond them it lets more single shingles through, which only cost rows.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
_BLOCK = 1 << 13
_SIGNATURE = ["s0", "s1", "s2", "s3"]

_SCAN = "doc_id long, digest binary, n_shingles long, block int, counts binary"
_SCAN_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())]
)


def shingle_set(text: str | None, hashes: WordHashes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, A-Z in lower case, and its distinct shingles, hashed and ascending."""
    found = words(text.lower() if text is not None and text.isascii() else _ascii_lower(text))
    if len(found) < WINDOW:
        whole = mixed(np.array([hashes[b" ".join(found)]], np.uint64)) if found else np.zeros(0, np.uint64)
        return found, whole
    return found, np.unique(windows(hashes.of(found), WINDOW))


def _ascii_lower(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def scan(docs: DataFrame) -> DataFrame:
    """For each row its digest and set size; for each task its counts of buckets, in blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for ids, texts in small_columns_of(batches):
            digests, sizes = [], []
            for text in texts:
                found, shingles = shingle_set(text, hashes)
                digests.append(digest(found) if found else None)
                sizes.append(len(shingles))
                np.add.at(counts, _bucket(shingles), np.uint32(1))
            none = [None] * len(ids)
            yield batch_of(_SCAN_ARROW, [ids, digests, sizes, none, none])
        blocks = [b for b in range(0, 1 << COUNT_BITS, _BLOCK) if counts[b : b + _BLOCK].any()]
        none = [None] * len(blocks)
        yield batch_of(
            _SCAN_ARROW,
            [none, none, none, [b // _BLOCK for b in blocks], [zlib.compress(counts[b : b + _BLOCK].tobytes(), 1) for b in blocks]],
        )

    return docs.mapInArrow(rows, _SCAN)


def frequency_levels(blocks: DataFrame) -> np.ndarray:
    """For each bucket a rough logarithm of its count: what the order of shingles starts with."""

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(_BLOCK, np.uint32)
        for packed in rows["counts"]:
            counts += np.frombuffer(zlib.decompress(packed), np.uint32)
        return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(counts.tobytes(), 1)]})

    schema = "block int, counts binary"
    # in two steps, so that no task gathers a block of all tasks
    parts = blocks.select("block", "counts").groupBy("block", F.pmod(F.xxhash64("counts"), F.lit(64))).applyInPandas(
        summed, schema
    )
    levels = np.zeros(1 << COUNT_BITS, np.uint8)
    for block, packed in parts.groupBy("block").applyInPandas(summed, schema).collect():
        counts = np.frombuffer(zlib.decompress(packed), np.uint32)
        levels[block * _BLOCK : (block + 1) * _BLOCK] = np.minimum(4 * np.log2(1 + counts.astype(float)), 255)
    return levels


def least_overlap(n: int) -> int:
    """The shingles that a set of n shares at least with any set alike."""
    return (4 * n + 4) // 5


def first_prefix(n: int) -> int:
    """The length of the 1-prefix of a set of n; each shingle more asks for one match more."""
    return n - least_overlap(n) + 1


def match_levels(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least m of which the shingle at a position (from 1) of a set of n is in the m-prefix."""
    return np.maximum(1, pos - first_prefix(n) + 1)


def prefix(shingles: np.ndarray, levels: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The longest prefix needed of a set, the match level of each shingle in it, and its m.

    usual: the level of a bucket that holds nothing frequent.
    """
    n = len(shingles)
    level = levels[_bucket(shingles)]
    order = np.lexsort((shingles, level))
    shingles, level = shingles[order], level[order]
    first = first_prefix(n)
    most = min(MOST_MATCHES, least_overlap(n))
    df = np.maximum(1.0, 2.0 ** (level[: first + most - 1] / 4) - 2.0 ** (usual / 4))
    sums = np.cumsum(df)
    matches = np.arange(1, most + 1)
    rows = sums[first - 1 : first + most - 1]
    m = int(np.argmin(rows + VERIFY_COST * rows / matches)) + 1
    length = first + m - 1
    return shingles[:length], match_levels(np.arange(1, length + 1), n), m


def signature(shingles: np.ndarray) -> np.ndarray:
    """256 parities of a set, as four numbers."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def asked_rows(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose id, the first column, may be in a bitmap."""
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy(zero_copy_only=False))))


def prefixes(docs: DataFrame, firsts: np.ndarray, levels: np.ndarray) -> DataFrame:
    """A row (doc, set size n, m, prefix, signature) for each of the first documents among docs
    (doc_id, text) that has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((firsts, levels))
    fields = [("doc", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("prefix", pa.list_(pa.int64()))]
    schema = pa.schema([*fields, *[(s, pa.int64()) for s in _SIGNATURE]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        firsts, levels = shared.value
        usual = float(np.median(levels))
        for ids, texts in small_columns_of(asked_rows(batches, firsts)):
            held = []
            for doc, text in zip(ids, texts, strict=True):
                shingles = shingle_set(text, hashes)[1]
                if len(shingles):
                    found, _, m = prefix(shingles, levels, usual)
                    held.append((doc, len(shingles), m, found.view(np.int64), *signature(shingles)))
            if held:
                yield batch_of(schema, list(zip(*held, strict=True)))

    return docs.mapInArrow(rows, "doc long, n long, m long, prefix array<long>, " + ", ".join(f"{s} long" for s in _SIGNATURE))


def index_rows(written: DataFrame, again: np.ndarray) -> DataFrame:
    """Rows (shingle, doc, n, m, pos, before, level) of the shingles in prefixes that may occur again.

    pos: from 1. before: how many of those before it may occur again. level: the least m of which the
    shingle is in the m-prefix.
    """
    shared = written.sparkSession.sparkContext.broadcast(again)
    names = ["shingle", "doc", "n", "m", "pos", "before", "level"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, n, m = (batch.column(k).to_numpy() for k in range(3))
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            shingle = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            starts = (np.cumsum(sizes) - sizes)[row]
            at = np.flatnonzero(in_bitmap(shared.value, shingle))
            own = row[at]
            pos = at - starts[at] + 1
            kept = np.bincount(own, minlength=len(sizes))
            before = np.arange(len(at)) - (np.cumsum(kept) - kept)[own]
            columns = [shingle[at], doc[own], n[own], m[own], pos, before, match_levels(pos, n[own])]
            yield from long_rows(names, columns)

    return written.select("doc", "n", "m", "prefix").mapInArrow(rows, ", ".join(f"{name} long" for name in names))


def signatures(written: DataFrame) -> DataFrame:
    """(doc, n, signature): null where texts of one doc and n have several."""
    of = F.struct(*_SIGNATURE)
    found = written.groupBy("doc", "n").agg(F.min(of).alias("least"), F.max(of).alias("most"))
    return found.select("doc", "n", F.when(F.col("least") == F.col("most"), F.col("least")).alias("signed"))


def allowed_by_place(x: str, y: str) -> Column:
    """Whether the positions of a shared shingle allow similarity 0.8 of rows x and y.

    It takes a common share of 4 / 9 of both sizes.
    """
    c = F.col
    rest = F.least(c(f"{x}n") - c(f"{x}pos"), c(f"{y}n") - c(f"{y}pos"))
    overlap = F.least(c(f"{x}before"), c(f"{y}before")) + 1 + rest
    return 9 * overlap >= 4 * (c(f"{x}n") + c(f"{y}n"))


def allowed_by_signature(x: str, y: str) -> Column:
    """Whether the signatures of x and y do: sets alike differ in a ninth of both sizes at most."""
    c = F.col
    apart = sum((F.bit_count(c(f"{x}signed.{s}").bitwiseXOR(c(f"{y}signed.{s}"))) for s in _SIGNATURE), F.lit(0))
    return F.coalesce(9 * apart <= c(f"{x}n") + c(f"{y}n"), F.lit(True))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids of which some texts are alike, by their whole sets."""
    pairs = checkpointed(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for doc_ids, texts in small_columns_of(asked_rows(batches, bitmap.value)):
            kept = [(d, shingle_set(t, hashes)[1]) for d, t in zip(doc_ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in kept], pa.int64()), pa.array([s.tobytes() for _, s in kept], pa.binary())],
                names=["doc", "shingles"],
            )

    found = docs.mapInArrow(sets, "doc long, shingles binary")
    both = (
        pairs.join(found.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
        .join(found.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, xs, ys in columns_of(batches, 500):
            keep = []
            for x, y in zip(xs, ys, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"]
            )

    return checkpointed(both.mapInArrow(alike, "a long, b long"))


def similar_links(docs: DataFrame, firsts: np.ndarray, levels: np.ndarray) -> DataFrame:
    """Links (a, b) between first documents of docs (doc_id, text); their components are exact.

    firsts: a bitmap of their ids. A copy found in it by chance is treated as a first document
    too; its link to the true first is right.
    """
    written = stored(prefixes(docs, firsts, levels))
    counts = written.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count()
    once_more = checkpointed(counts.filter("count > 1").select("shingle"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * once_more.count()).bit_length()))
    index = stored(index_rows(written, bitmap_of(once_more, "shingle", bits)))
    signed = checkpointed(signatures(written))
    lead = F.min(F.struct("pos", "doc", "n", "before")).alias("lead")
    leaders = (
        index.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), lead).filter("size > 1")
        .select("shingle", *[F.col(f"lead.{c}").alias(f"l_{c}") for c in ("pos", "doc", "n", "before")])
    )
    shared = stored(index.join(leaders, "shingle"))
    best = (
        shared.filter(F.col("doc") != F.col("l_doc"))
        .filter(allowed_by_place("", "l_"))
        .groupBy("doc", "n", "l_doc", "l_n")
        .agg(F.count(F.lit(1)).alias("matches"))
        .join(signed, ["doc", "n"])
        .join(signed.select(*[F.col(c).alias(f"l_{c}") for c in ("doc", "n", "signed")]), ["l_doc", "l_n"])
        .filter(allowed_by_signature("", "l_"))
        .groupBy("doc")
        .agg(F.max(F.struct("matches", -F.col("l_doc"), "l_doc")).alias("best"))
    )
    first = verified(docs, best.select(F.col("doc").alias("a"), F.col("best.l_doc").alias("b")))
    labels = checkpointed(components(first))
    marked = shared.drop("l_pos", "l_doc", "l_n", "l_before").join(labels, F.col("doc") == F.col("node"), "left")
    marked = stored(marked.withColumn("component", F.coalesce("component", "doc")).drop("node"))
    largest = (
        marked.groupBy("shingle", "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("size", "component")).alias("top"))
        .filter("components > 1")
        .select("shingle", F.col("top.component").alias("major"))
    )
    open_rows = stored(marked.join(largest, "shingle").join(signed, ["doc", "n"]))
    x = open_rows.filter("component <> major").select(*[F.col(c).alias(f"x_{c}") for c in open_rows.columns])
    y = open_rows.select(*[F.col(c).alias(f"y_{c}") for c in open_rows.columns])
    m = F.least("x_m", "y_m")
    pairs = (
        x.join(
            y,
            (F.col("x_shingle") == F.col("y_shingle"))
            & (F.col("x_component") != F.col("y_component"))
            & ((F.col("y_component") == F.col("x_major")) | (F.col("x_doc") < F.col("y_doc")))
            & (F.col("x_level") <= m)
            & (F.col("y_level") <= m)
            & allowed_by_place("x_", "y_")
            & allowed_by_signature("x_", "y_"),
        )
        .groupBy(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b"), m.alias("m"))
        .agg(F.count(F.lit(1)).alias("matches"))
        .filter("matches >= m")
    )
    return first.union(verified(docs, pairs))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles and component_id.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of the same
    doc_id are one document, linked with whatever one of its texts is linked with. A row without
    doc_id gets the component of the documents of the same words, or null. Other columns are not
    read. An empty table gives an empty result.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    scanned = stored(scan(docs))
    rows = scanned.filter("n_shingles is not null").select("doc_id", "digest", "n_shingles")
    levels = frequency_levels(scanned.filter("block is not null"))
    classes = checkpointed(
        rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    ).filter("first_id is not null")
    firsts = bitmap_of(classes, "first_id")
    known = docs.filter("doc_id is not null")
    copies = (
        rows.filter("doc_id is not null").join(classes, "digest").filter("doc_id <> first_id")
        .select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).distinct()
    )
    near = checkpointed(components(similar_links(known, firsts, levels)))
    # a copy has one first document, so it joins that document's component, unless it has several texts
    own = F.coalesce("component", "b")
    tied = copies.join(near, F.col("b") == F.col("node"), "left").select(F.col("a"), own.alias("b"))
    final = checkpointed(components(tied.union(near.select(F.col("node").alias("a"), F.col("component").alias("b"))).filter("a <> b")))
    by_class = rows.join(classes, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("doc_id", "first_id").alias("key")
    )
    return by_class.join(final, F.col("key") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "key").alias("component_id")
    )


def word_key(text: Column) -> Column:
    """A hash of a text's words, A-Z in lower case; null without words. DataFrame functions only."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(spaced) > 0, F.sha2(spaced, 256))


def one_row_each(docs: DataFrame, key: str) -> DataFrame:
    """One row for each value of a column: that of the least text, null texts first."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rank = F.struct(F.col("text").isNotNull(), F.col("text").cast("string"))
    return docs.groupBy(F.col(key)).agg(F.min_by(row, rank).alias("one")).select("one.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, or without any shingle.

    Rows that share this doc_id are one document, of which the row of the least text stays. Of rows
    without doc_id those go that have the words of a row with doc_id; of others of the same words
    one stays, and those without words all stay.
    """
    names = docs.columns
    later_id, key = unused(["later_id", "word_key"], names)
    ids = docs["doc_id"].cast("long")
    found = jaccard_components(docs).filter("doc_id is not null")
    later = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(later_id)).distinct()
    kept = docs.filter(ids.isNotNull()).join(later, ids == F.col(later_id), "left_anti")
    again = checkpointed(found.groupBy(F.col("doc_id").alias(later_id)).count().filter("count > 1").select(later_id))
    if not again.isEmpty():
        several = one_row_each(kept.join(again, ids == F.col(later_id), "left_semi").withColumn(later_id, ids), later_id)
        kept = kept.join(again, ids == F.col(later_id), "left_anti").union(several.select(*kept.columns))
    nameless = docs.filter(ids.isNull())
    if nameless.isEmpty():
        return kept
    nameless = nameless.withColumn(key, word_key(docs["text"].cast("string")))
    named = docs.filter(ids.isNotNull()).select(word_key(docs["text"].cast("string")).alias(key)).distinct()
    wordless = nameless.filter(F.col(key).isNull()).select(*kept.columns)
    others = one_row_each(nameless.filter(F.col(key).isNotNull()).join(named, key, "left_anti"), key)
    return kept.union(wordless).union(others.select(*kept.columns))
