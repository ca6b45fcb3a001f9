"""Fingerprints against winnowing written out window by window."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from geoaffinity.llm import winnowing
from geoaffinity.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
LOW = (1 << 15) - 1


def grams(text, gram):
    if not text:
        return []
    starts = range(max(1, len(text) - gram + 1))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(xxhash.xxh64_intdigest(text[p : p + gram].encode("utf-32-be"), seed=42)) for p in starts]


def brute(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """(places, hashes): the rightmost least of every window, hashes compared without their low bits."""
    h = grams(text, gram)
    places = []
    for first in range(max(1, len(h) - window + 1) if h else 0):
        inside = range(first, min(first + window, len(h)))
        best = min(inside, key=lambda p: (h[p] | LOW, -p))
        if not places or places[-1] != best:
            places.append(best)
    return places, [h[p] for p in places]


def brute_edits(rows, gram=winnowing.GRAM, window=winnowing.WINDOW):
    order = sorted((i, t or "") for i, t in rows if i is not None)
    found = []
    for n, (i, t) in enumerate(order):
        found.append((i, t, order[(n + 1) % len(order)][1]))
    found += [(None, t or "", None) for i, t in rows if i is None]
    out = []
    for i, t, following in found:
        cut = len(t) // 4
        edited = t[: len(t) - cut] + (following or "")[:cut]
        marks, others = brute(t, gram, window), brute(edited, gram, window)
        write = lambda pair: " ".join(f"{p}:{h & (1 << 64) - 1:X}" for p, h in zip(*pair, strict=True))
        alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
        near = None if following is None else alike(marks[1], brute(following, gram, window)[1])
        out.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), write(marks), write(others), alike(marks[1], others[1]), near)
        )
    return sorted(out, key=repr)


def texts(seed=3):
    chance = random.Random(seed)
    prose = lambda n, letters: "".join(chance.choice(letters) for _ in range(n))
    return [
        "", None, "a", "short", "x" * 15, "x" * 16, "x" * 46, "x" * 47, "x" * 5000, prose(61, "ab "),
        prose(300, "aé😀 \n"), prose(9000, "abcdefgh "), prose(4096 + 46, "ab"), prose(4096 + 47, "abc"), "ab" * 4100,
    ]


DOCS = "doc_id long, text string, next_text string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def test_fingerprints_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    for gram, window in ((winnowing.GRAM, winnowing.WINDOW), (5, 4), (3, 7), (4, 1)):
        got = winnowing.fingerprints(frame(spark, rows), gram, window).collect()
        assert len(got) == len(rows)
        for i, n, places, hashes in got:
            text = dict(rows)[i] or ""
            assert (n, (places, hashes)) == (len(text), brute(text, gram, window))


@pytest.mark.parametrize("first", [None, 17])
def test_edits_equal_brute_force(spark, first):
    ids = [7, 3, -5, 10**15, 4, 4, 4, None, None, 2, 11, 12, 13, 14, first]
    rows = list(zip(ids, texts(), strict=True))
    rows += [(100 + n, f"document {n} " * (n % 50)) for n in range(400)]
    got = winnowing.fingerprint_edits(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_edits(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone " * 30)], [(None, "alone " * 30), (None, None)], [(2, None)], [(5, "a b " * 40)] * 300])
def test_small_tables(spark, rows):
    got = winnowing.fingerprint_edits(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_edits(rows)


def test_shared_passages_share_a_hash(spark):
    chance = random.Random(1)
    prose = lambda n: "".join(chance.choice("abcdefghij ") for _ in range(n))
    passage = prose(winnowing.GRAM + winnowing.WINDOW - 1)
    rows = [(n, prose(chance.randint(0, 300)) + passage + prose(chance.randint(0, 300))) for n in range(60)]
    got = [set(r["hashes"]) for r in winnowing.fingerprints(frame(spark, rows)).collect()]
    assert all(a & b for a in got for b in got)


def test_query_over_the_given_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op11_winnowing"](spark, FOLDER)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"),
        ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_edits([(r[0], r[1]) for r in rows])


def test_texts_are_shuffled_once_and_without_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = winnowing.fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange ") == 1


def test_buckets_hold_neighbours(spark):
    rows = spark.range(5000).selectExpr("id * 37 % 5003 AS doc_id", "'t' AS text")
    bounds = winnowing.id_bounds(rows.select("doc_id"), 5000)
    put = winnowing.with_buckets(rows, bounds, 4).filter(~F.col("guest"))
    ranges = sorted(map(tuple, put.groupBy("bucket").agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).collect()))
    assert [r[1] for r in ranges] == bounds and all(a[2] < b[1] for a, b in zip(ranges, ranges[1:], strict=False))
    assert max(r[3] for r in ranges) < 4 * winnowing.BUCKET_ROWS
