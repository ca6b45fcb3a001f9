"""The sorted sparse suffixes against brute force over all windows of 50 words."""

import collections
import random

import pytest

from geoaffinity.llm import suffix_dedup
from geoaffinity.llm.suffix_dedup import LENGTH

DOCS = "doc_id long, text string"


def prose(seed, n, letters="abcdefghij"):
    chance = random.Random(seed)
    return ["".join(chance.choice(letters) for _ in range(6)) for _ in range(n)]


def brute(rows):
    """Word positions by document: of first occurrences that occur again, and of repeats.

    A text that has copies is a first occurrence as a whole, wherever its parts stand.
    """
    texts = {i: tuple((t or "").encode().split()) for i, t in rows if i is not None}
    seen, places = {}, collections.defaultdict(list)
    cut, copies = collections.defaultdict(set), set()
    for i in sorted(texts):
        if len(texts[i]) >= LENGTH and seen.setdefault(texts[i], i) != i:
            cut[i].update(range(len(texts[i])))
            copies.add(i)
    for i in sorted(texts):
        if i not in copies:
            for q in range(len(texts[i]) - LENGTH + 1):
                places[texts[i][q : q + LENGTH]].append((i, q))
    kept = collections.defaultdict(set)
    for found in places.values():
        for n, (i, q) in enumerate(found):
            if len(found) > 1:
                (cut if n else kept)[i].update(range(q, q + LENGTH))
    for i in copies:
        kept[seen[texts[i]]].update(range(len(texts[i])))
    return dict(kept), dict(cut)


def found(rows):
    kept, cut = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        assert r["n_words"] == r["end"] - r["start"] >= LENGTH and r["other_id"] is not None
        assert not r["repeat"] or r["other_id"] <= r["doc_id"]
        (cut if r["repeat"] else kept)[r["doc_id"]].update(range(r["start"], r["end"]))
    return dict(kept), dict(cut)


def passages():
    """Passages of 50 to 5,000 words in other surroundings, one with a hot head and many ends."""
    chance, rows = random.Random(3), []
    for n, size in enumerate([49, 50, 51, 60, 73, 74, 75, 100, 333, 5000]):
        shared = prose(1000 + n, size)
        for k in range(chance.randint(2, 5)):
            rows.append([*prose(f"{n} {k}", chance.randint(0, 40)), *shared, *prose(f"e{n} {k}", chance.randint(0, 40))])
    hot = prose(7, 120)
    for k in range(150):
        low, high = chance.randint(0, 60), chance.randint(60, 120)
        rows.append([*prose(f"h{k % 9}", k % 9), *hot[low:high], *prose(f"t{k % 4}", 5 * (k % 4))])
    rows.append([*hot, "between", *hot, *hot[:50]])
    return rows


def repetitive():
    """Few words, periods, one word again and again, words longer than are sorted."""
    chance = random.Random(4)
    base = [[chance.choice("ab") for _ in range(90)] for _ in range(3)]
    rows = [[*chance.choice(base)[chance.randint(0, 30) :], *chance.choice(base)[: chance.randint(20, 90)]] for _ in range(40)]
    rows += [["a"] * 130, ["a"] * 51, list("abc") * 60, list("bca") * 40, ["a"] * 70 + ["b"] * 70]
    long = [f"{'x' * 70}{n}" for n in range(60)]
    return rows + [[*long, "end"], ["begin", *long], [f"{'x' * 70}{n + (n == 30)}" for n in range(60)]]


@pytest.mark.parametrize("texts", [passages, repetitive])
def test_passages_equal_brute_force(spark, texts):
    rows = [(3 * n + 1, " \n"[n % 2].join(t)) for n, t in enumerate(texts())]
    rows += [(900_000, rows[3][1]), (900_001, rows[3][1].replace("\n", "  ")), (None, rows[0][1]), (900_002, None), (900_003, "")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([*rows, rows[5], rows[6]], DOCS)
    want = brute(rows)
    got = suffix_dedup.repeated_passages(docs).collect()
    assert found(got) == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:  # many partitions, so that runs of equal suffixes cross their borders
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert sorted(map(tuple, suffix_dedup.repeated_passages(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_neighbours_of_all_partitionings_say_the_same():
    """compare() over sorted suffixes cut anywhere: the same repeats, once borders are resolved."""
    tail = b"\t".join(b"%d" % n for n in range(LENGTH))
    rows = sorted((head + tail + b"\n" + before, doc, 5, 0, 3) for head in (b"a\t", b"b\t") for before in (b"x", b"y") for doc in range(4))
    for at in range(len(rows) + 1):
        out = [r for part in (rows[:at], rows[at:]) for r in suffix_dedup.compare(iter(part))]
        repeats = {(r[0], r[1], r[2]) for r in out if r[2] is not None and r[2] > 0}
        assert {doc for doc, _, _ in repeats} <= {1, 2, 3}
        grouped = {r[0] for r in out if r[2] is None and r[0] is not None}
        assert {0, 1, 2, 3} == {d for d, _, _ in repeats} | grouped
    assert list(suffix_dedup.compare(iter([]))) == []
