"""Pipeline stages on empty tables, nulls, repeated rows, long texts and clashing column names."""

import collections
import random

import pytest
from tokenizers import Tokenizer

from geoaffinity.llm import jaccard_join, mixing, suffix_dedup, token_counts, toxicity
from geoaffinity.llm.merges import read_merges
from geoaffinity.llm.queries import tokenizer

CLASHES = [
    "later_id", "word_key", "cut_id", "cuts", "is_cut", "of_doc", "of_size", "times", "nth", "copy", "copies", "key",
    "node", "component", "component_id", "digest", "size", "rank", "block", "bucket", "taken", "score", "predicted", "one",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(seed, n):
    chance = random.Random(seed)
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    full = [(i, t, "en", s, len(t or ""), *[f"{c}{n}" for c in CLASHES]) for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def stages(spark):
    labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(1, 40)], "doc_id long, quality int, toxic int")
    return {
        "toxicity": lambda docs: toxicity.without_toxic(docs, labels),
        "jaccard": jaccard_join.one_of_each,
        "suffix": suffix_dedup.without_repeats,
        "mixing": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["toxicity", "jaccard", "suffix", "mixing"])
def test_stage_takes_odd_tables(spark, name):
    stage = stages(spark)[name]
    rows = [(n, prose(n, 80), "ab"[n % 2]) for n in range(12)]
    rows += [(None, None, None), (20, "", "a"), (21, None, "b"), (None, prose(3, 80), "a"), (22, prose(1, 60_000), "b")]
    rows += [rows[2], rows[2], (23, rows[4][1], "a"), (None, "few words", "a"), (None, "few words", "b")]
    docs = frame(spark, rows)
    out = stage(docs).collect()
    assert out and set(out[0].asDict()) == set(docs.columns)
    given = {r["digest"]: r for r in docs.collect()}
    assert all(r["doc_id"] == given[r["digest"]]["doc_id"] and r["one"] == given[r["digest"]]["one"] for r in out)
    assert stage(docs.limit(0)).collect() == []
    for odd in ([(None, None, None)], [(1, "", None)] * 3, [(None, "x", "a")] * 3):
        assert stage(frame(spark, odd)).columns == docs.columns
        stage(frame(spark, odd)).collect()


def test_one_row_of_each_document_stays(spark):
    rows = [(n, prose(n, 60), "a") for n in range(5)] * 2 + [(7, "b words", "a"), (7, "a words", "a"), (8, None, "a"), (8, "", "a")]
    rows += [(None, prose(2, 60).upper(), "a"), (None, "only  here", "b"), (None, "Only here", "b"), (None, "", "b"), (None, None, "b")]
    out = jaccard_join.one_of_each(frame(spark, rows)).collect()
    found = collections.Counter(r["doc_id"] for r in out)
    assert found == {**dict.fromkeys([0, 1, 2, 3, 4, 7, 8], 1), None: 3}
    assert {r["text"] for r in out if r["doc_id"] == 7} == {"a words"}
    assert sorted(map(str, (r["text"] for r in out if r["doc_id"] is None)))[:2] == ["", "None"]


def test_small_sources_come_near_their_targets(spark):
    rows, sizes = [], {}
    for s, words in enumerate([1, 2, 3, 5, 10, 10, 10, 31, 32, 33, 64, 100, 7, 10, 40]):
        sizes[f"s{s:02}"] = words
        for n in range(words):
            rows.append((1000 * s + n, f"w{n}", f"s{s:02}"))
    for part in (rows, [r for r in rows if r[2] in ("s00", "s01")], [(1, "a b c d e f g h i j", "x")]):
        got = mixing.mix_sources(frame(spark, part)).collect()
        target, taken = {}, collections.Counter()
        source_of = {i: s for i, _, s in part}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            target[source_of[r["doc_id"]]] = r["target"]
            taken[source_of[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - t) <= max(2, 0.05 * t) for s, t in target.items()), (dict(taken), target)


def test_rows_without_id_are_spread_over_buckets(spark):
    rows = [(None, prose(n, 5), "a") for n in range(3000)] + [(n, "one", "b") for n in range(10)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got if r["doc_id"] is None) == 15_000


def test_slots_are_laid_out_by_as_many_tasks_as_they_need(spark):
    docs = frame(spark, [(1, "a b", "a")])
    counts = spark.createDataFrame([(0, 0, 1, 9, 1, 0)], "rank long, shard long, taken long, source_size long, block_words long, start long")
    shown = mixing.block_takes(counts, 5 * mixing._TASK_SLOTS, 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rank" in shown and ", 5), REPARTITION_BY_NUM" in shown
    assert mixing.mix_sources(docs).count() == 1


def test_letters_newer_than_the_tokenizer_are_split_as_it_splits_them():
    path = tokenizer("byte_bpe_50k.json")
    counter = token_counts.TokenCounter(path, token_counts.prove_whole(read_merges(path)))
    library = Tokenizer.from_file(path)
    chance = random.Random(4)
    texts = ["\U00016ecd's", "\U00018fa5's", "a\U00016ecd \U00016ecdb's <|endoftext|>\U00018fa5 1"]
    pool = [lambda: chance.randrange(32, 127), lambda: chance.randrange(0xD000), lambda: chance.randrange(0x16000, 0x19000), lambda: 0x27]
    texts += ["".join(chr(chance.choice(pool)()) for _ in range(chance.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids), ascii(text)
