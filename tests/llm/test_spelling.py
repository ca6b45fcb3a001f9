"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from geoaffinity.llm import spelling
from geoaffinity.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n string, no string"
CAPITALS = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = {}
    for word in counts:
        by_length.setdefault(len(word), []).append(word)
    near, form = {}, {}
    for w, n in counts.items():
        near[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def result(docs):
    return sorted(map(tuple, spelling.group_variants(docs).collect()), key=repr)


def test_random_words_equal_brute_force(spark):
    chance = random.Random(9)
    rows = []
    for i in range(40):
        words = []
        for _ in range(500):
            word = "".join(chance.choice("abÉ") for _ in range(chance.randint(4, 9)))
            words += [word] * (chance.choice([1, 1, 1, 3, 9]) if word[0] == "a" else 1)
        rows.append((i, chance.choice([" ", ", ", "-", " "]).join(words)))
    want = brute(rows)
    assert len(want) > 500 and sum(r[1] is not None for r in want) > 20
    assert result(frame(spark, rows).repartition(6)) == want


def test_runs_ties_and_chains(spark):
    def times(word, n):
        return (f"{word} " * n).strip()

    rows = [
        (1, times("aaaaaa", 200)), (2, times("aaaaaaa", 40)), (3, times("aaaaaaaa", 8)),  # a chain
        (4, times("bcdefg", 5)), (5, times("bcdefh", 30) + " " + times("bcdefi", 30)),  # a tie
        (6, times("bcdefg", 1) + " " + times("xbcdefg", 500)),
        (7, times("MÜLLER", 6) + times(" müller", 30) + times(" mÜller", 31)),  # only A-Z are lowered
        (8, None), (9, ""), (None, times("nothing", 9)), (None, times("nothings", 50)), (9, times("q" * 3000, 5)),
        (9, times("q" * 3001, 25)), (10, "1234 5678 çàéîöû÷× çàéîöû÷×, " * 5), (1, times("aaaaaa", 3)),
    ]
    got = result(frame(spark, rows))
    assert got == brute(rows)
    forms = {r[0]: r[1:3] for r in got}
    assert forms["aaaaaaaa"] == ("aaaaaaa", "aaaaaa")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "few words")]])
def test_nothing_to_group(spark, rows):
    assert result(frame(spark, rows)) == []


def test_node_numbers_name_prefixes():
    words = sorted({"".join(random.Random(n).choices("ab", k=random.Random(n).randint(6, 10))) for n in range(300)})
    numbers, named = spelling.NodeNumbers(3), {}
    for word in words:
        for depth, node in enumerate(numbers.of(word)):
            assert named.setdefault(node, word[:depth]) == word[:depth]
    assert len(set(named.values())) == len(named)


def test_query_over_the_given_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op12_spelling_variants"](spark, FOLDER)
    assert got.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"),
        ("form_n", "bigint"),
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r[0], r[1]) for r in rows])
