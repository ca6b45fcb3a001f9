"""Filter interaction audit: what each of five filters removes in each of the 120 orders.

Every text gets a mask of the filters that it fails. Counting masks per part gives the removals of
all 32 coalitions of filters: a coalition removes the texts whose mask meets it. A step of an order
is then the difference between two coalitions, and a filter's Shapley value is the solution of a
least squares problem over the coalitions: Shapley kernel weights, values that sum to the removals
of all five (efficiency). Its normal equations are solved once, in rationals, so values are exact.

Texts are read once, into rows of an id, a digest and a mask. Whether a text is a copy of an
earlier one needs no group of copies in one task: the least doc_id of each digest is a partial
minimum, and rows meet it by digest and doc_id together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, columns_of, stored, utf8

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
FEW_WORDS = 200
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOL = re.compile(rb"[#$%&*|]")
#: The bit of the filter that the text alone cannot decide.
COPY = 1 << FILTERS.index("E")

COUNTS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
_ARROW = pa.schema(
    [
        pa.field(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind])
        for name, kind in (c.split() for c in COUNTS.split(", "))
    ]
)
_FACTS = pa.schema(
    [
        pa.field("doc_id", pa.int64()),
        pa.field("part", pa.string()),
        pa.field("digest", pa.binary()),
        pa.field("mask", pa.int32()),
    ]
)


def text_mask(raw: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails, as bits 0 to 3."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))
    return (
        (len(words) < FEW_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * points) << 2
        | (SYMBOL.search(raw) is not None) << 3
    )


def text_facts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, mask), one for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts, texts in columns_of(batches):
            raw = [utf8(text) for text in texts]
            digests = [hashlib.sha256(r).digest() for r in raw]
            yield batch_of(_FACTS, [ids, [p or "" for p in parts], digests, [text_mask(r) for r in raw]])

    columns = docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"].cast("string")
    return docs.select(*columns).mapInArrow(rows, "doc_id long, part string, digest binary, mask int")


def mask_counts(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): texts of a part that fail exactly the mask's filters."""
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"),
        F.max((labels["toxic"] == 1).cast("int")).alias("toxic"),
    )
    # Rows without id match nothing and are no copies.
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        facts.join(first, ["digest", "doc_id"], "left")
        .select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))
        .join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def removals(by_mask: list[int]) -> list[int]:
    """For each coalition of filters the texts that it removes: those whose mask meets it."""
    return [sum(n for mask, n in enumerate(by_mask) if mask & s) for s in range(len(by_mask))]


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """matrix^-1 right, by elimination in rationals."""
    size = len(matrix)
    rows = [[*left, *values] for left, values in zip(matrix, right, strict=True)]
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(size):
            if r != k and rows[r][k]:
                times = rows[r][k]
                rows[r] = [x - times * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[size:] for row in rows]


def shapley_operator(players: int = len(FILTERS)) -> list[list[Fraction]]:
    """The matrix that turns the values of all coalitions into the players' Shapley values.

    Values x minimise the sum over proper coalitions s of w(s) (v(s) - v(0) - sum of x in s)^2,
    w(s) = (n - 1) / (C(n, |s|) |s| (n - |s|)), such that all x sum to v(all) - v(0). The normal
    equations with the multiplier of that condition as a further unknown are linear in v, so they
    are solved for every unit vector of v at once.
    """
    everyone = (1 << players) - 1
    matrix = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [[Fraction(0)] * (everyone + 1) for _ in range(players + 1)]
    for s in range(1, everyone):
        members = [i for i in range(players) if s >> i & 1]
        weight = Fraction(players - 1, comb(players, len(members)) * len(members) * (players - len(members)))
        for i in members:
            for j in members:
                matrix[i][j] += weight
            right[i][s] += weight
            right[i][0] -= weight
    for i in range(players):
        matrix[i][players] = matrix[players][i] = Fraction(1)
    right[players][everyone] += 1
    right[players][0] -= 1
    return solved(matrix, right)[:players]


def audit_rows(part: str, counts: list[tuple[int, int, int, int]], operator: list[list[Fraction]]) -> list[tuple]:
    """The rows of one part; counts: (mask, n, good, toxic)."""
    tables = [[0] * MASKS for _ in range(3)]
    for mask, *values in counts:
        for table, value in zip(tables, values, strict=True):
            table[mask] += value
    texts, (lost, good, toxic) = tables[0], map(removals, tables)
    everything = sum(texts)
    orders = factorial(len(FILTERS))
    shapley = [orders * sum(c * v for c, v in zip(row, lost, strict=True)) for row in operator]
    rows = []
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = lost[after] - lost[before]
            rows.append(
                (
                    part, name, step, everything - lost[after], removed, lost[1 << f] - removed, texts[1 << f],
                    good[after] - good[before], toxic[after] - toxic[before], int(shapley[f]),
                )
            )
            before = after
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows for each part (value of docs.lang): every step of every order of the filters.

    docs (doc_id, text, lang): a null text is empty, a null lang the part ''. A row without doc_id
    is no copy of another, nor is another a copy of it; of rows that share a doc_id and a text
    neither is a copy. labels (doc_id, quality, toxic): a document is good (toxic) if any of its
    labels says 1; labels without a document, without doc_id or null count nothing. Texts are the
    same if their SHA-256 are. Other columns are not read. Without documents there are no parts.
    """
    facts = stored(text_facts(docs))
    operator = shapley_operator()

    def one() -> Column:
        return F.struct("mask", "n", "good", "toxic")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, counts in columns_of(batches, 64):
            for part, of_part in zip(parts, counts, strict=True):
                found = audit_rows(part, [(c["mask"], c["n"], c["good"], c["toxic"]) for c in of_part], operator)
                yield batch_of(_ARROW, [list(c) for c in zip(*found, strict=True)])

    by_part = mask_counts(facts, labels).groupBy("part").agg(F.collect_list(one()).alias("counts"))
    return by_part.mapInArrow(rows, COUNTS)
