"""Mixing, nearest neighbours, Jaccard join, suffix dedup, language model and pipeline against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoaffinity.llm import context_mixing, jaccard_join, kmeans_tree, links, mixing, suffix_dedup

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string"


def prose(seed, n):
    chance = random.Random(seed)
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], DOCS)


# --- links ---------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(20, 40)]
    star = [(100, n) for n in range(101, 120)] + [(5, 119)]
    found = dict(links.components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect())
    assert found == {n: 20 for n in range(20, 41)} | {n: 5 for n in [5, *range(100, 120)]}
    assert links.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- Jaccard join --------------------------------------------------------------------------


def brute_components(rows):
    sets = collections.defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i].append(set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, sets


def near_rows():
    rows = [(n, prose(n, 60), "s") for n in range(10)]
    chance = random.Random(8)
    for n in range(40):  # one group of copies with changes, some beyond the threshold
        words = prose(1, 60).split()
        for _ in range(n % 5):
            words[chance.randint(0, 59)] = "changed"
        rows.append((100 + n, " ".join(words).upper() if n % 7 == 0 else " ".join(words), "s"))
    rows += [(n, prose(77, 40) + " " + prose(n, 30), "s") for n in range(200, 215)]
    return rows + [(300, "few words", "s"), (301, "Few  words", "s"), (302, "few word", "s"), (303, "", "s"), (304, None, "s"), (305, None, "s"), (3, prose(3, 60), "s"), (5, prose(6, 60), "s")]


def test_jaccard_components_equal_brute_force(spark):
    rows = near_rows()
    want, sets = brute_components([(i, t) for i, t, _ in rows])
    got = jaccard_join.jaccard_components(frame(spark, [*rows, (None, prose(2, 60), None)])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == want[2]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
    one = {r["doc_id"] for r in jaccard_join.one_of_each(frame(spark, rows)).collect()}
    assert one == {i for i in want if want[i] == i}
    assert jaccard_join.jaccard_components(frame(spark, rows).limit(0)).collect() == []


def test_prefixes_share_as_many_shingles_as_they_promise():
    chance = random.Random(4)
    levels = np.zeros(1 << jaccard_join.COUNT_BITS, np.uint8)
    for _ in range(100):
        common = {chance.getrandbits(64) for _ in range(chance.randint(20, 60))}
        sets = [np.array(sorted(common | {chance.getrandbits(64) for _ in range(len(common) // 9)}), np.uint64) for _ in "xy"]
        (x, _, mx), (y, _, my) = (jaccard_join.prefix(s, levels, 0.0) for s in sets)
        if 100 * len(common) >= 80 * len(set(sets[0].tolist()) | set(sets[1].tolist())):
            assert len(np.intersect1d(x, y)) >= min(mx, my)
            bits = jaccard_join.signature(sets[0]) ^ jaccard_join.signature(sets[1])
            apart = sum(int(b & ((1 << 64) - 1)).bit_count() for b in bits.tolist())
            assert apart <= len(sets[0]) + len(sets[1]) - 2 * len(common)


# --- suffix dedup --------------------------------------------------------------------------


def brute_repeats(rows):
    docs = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(docs):
        for q in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][q : q + 50]), (i, q))
    cut = {}
    for i, w in docs.items():
        found = {p for q in range(len(w) - 49) if first[tuple(w[q : q + 50])] != (i, q) for p in range(q, q + 50)}
        if found:
            cut[i] = found
    return docs, cut


def repeat_rows():
    passage = prose(50, 70)
    rows = [(n, f"{prose(n, 30)} {passage}\n{prose(n + 500, 20)}", "s") for n in range(20)]
    rows += [(30, prose(30, 80), "s"), (31, prose(30, 80).replace(" ", "\n"), "s"), (32, passage, "s"), (33, f"{prose(33, 60)} {prose(33, 60)}", "s")]
    return rows + [(40, passage.rsplit(" ", 21)[0], "s"), (41, "short", "s"), (42, None, "s"), (43, "", "s")]


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    docs, cut = brute_repeats([(i, t) for i, t, _ in rows])
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(frame(spark, [*rows, (None, rows[0][1], "s")])).collect():
        assert r["n_words"] == r["end"] - r["start"] >= 50
        if r["repeat"]:
            found[r["doc_id"]].update(range(r["start"], r["end"]))
    assert dict(found) == cut
    left = {r["doc_id"]: (r["text"] or "").encode().split() for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    want = {i: [w for n, w in enumerate(ws) if n not in cut.get(i, ())] for i, ws in docs.items()}
    assert left == {i: w for i, w in want.items() if w or not cut.get(i)}
    assert suffix_dedup.repeated_passages(frame(spark, rows).limit(0)).collect() == []


# --- mixing --------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_meets_its_targets_and_repeats(spark):
    chance = random.Random(6)
    names = ["b", "a", None, "", "d", "é", "c"]
    rows = [(n, prose(n, chance.randint(0, 300)), chance.choice(names + ["a"] * 6)) for n in range(400)]
    rows += [(None, "no id here", "a"), (5, rows[5][1], rows[5][2]), (999, None, "b")]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(dict(sizes))
    source_of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(160, 0.03 * target)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert {r["taken"] for r in mixing.mix_sources(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {0}
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("k")).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_mixing_runs_no_python(spark):
    shown = mixing.mix_sources(frame(spark, [(1, "a b c", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown


# --- nearest neighbours ----------------------------------------------------------------------


def test_nearest_neighbours_recall_ties_and_bad_vectors(spark):
    random_ = np.random.default_rng(1)
    vectors = random_.normal(size=(1500, 8)).astype(np.float32).tolist()
    for n in range(100, 500):
        vectors[n] = vectors[100]
    rows = [(n, v) for n, v in enumerate(vectors)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] + [0.0] * 6), (2400, [1.0, 2.0]), (2500, [math.inf] * 8), (None, vectors[0]), (7, vectors[7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in kmeans_tree.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    all_ = np.array(vectors, np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 1500, 100))
    for q, found in got.items():
        score = np.sqrt(np.square(all_ - all_[q]).sum(axis=1))
        score[q] = np.inf
        true = np.argsort(score, kind="stable")[:10].tolist()
        hits += len(set(true) & {v for v, _, _ in found})
        assert [n for _, _, n in found] == list(range(1, 11))
        assert all(math.isclose(s, score[v], rel_tol=1e-12) for v, s, _ in found)
        if 100 <= q < 500:
            assert [v for v, _, _ in found] == [v for v in range(100, 111) if v != q][:10]
    assert hits >= 0.9 * 10 * len(got)
    assert kmeans_tree.search(table.limit(0)).collect() == []
    assert len(kmeans_tree.search(table.filter("vec_id in (0, 3, 4)")).collect()) == 2


def test_every_length_of_vectors_is_searched(spark):
    chance = np.random.default_rng(3)
    short = {n: chance.normal(size=3).tolist() for n in range(0, 2000, 50)}
    long = {n: chance.normal(size=5).tolist() for n in range(25, 1200, 25) if n not in short}
    long[300_000] = chance.normal(size=5).tolist()
    table = spark.createDataFrame([*short.items(), *long.items(), (700_000, [1.0])], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in kmeans_tree.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == [*range(0, 2000, 100), 300_000]
    for query, found in got.items():
        group = short if query in short else long
        others = sorted((math.dist(v, group[query]), n) for n, v in group.items() if n != query)
        assert found == [n for _, n in others[:10]]


def test_queries_in_small_leaves_find_k_neighbours(spark, monkeypatch):
    chance = np.random.default_rng(6)
    rows = [(n, [float(x) for x in chance.normal(size=4)]) for n in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("LEAF_ROWS", 5), ("LEAF_FIT", 5), ("LEAF_ROOTS", 0), ("calibrated_visits", lambda *_: 1)):
        monkeypatch.setattr(kmeans_tree, name, value)
    found = collections.Counter(r["query_id"] for r in kmeans_tree.search(table, every=50).collect())
    assert found == {n: 10 for n in range(0, 400, 50)}


# --- language model --------------------------------------------------------------------------


def test_language_model_base_and_scores(spark):
    folder = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (9001, ""), (9002, "xq " * 70_000)], "doc_id long, text string")
    docs = folder.select("doc_id", "text").union(odd).withColumn("score", F.lit("clash"))
    rows = context_mixing.score_texts(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    assert len(rows) == len(texts)
    held_out = {i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i in texts}
    counts = collections.Counter(t for i, ts in texts.items() if not held_out[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out[r["doc_id"]], len(tokens), n)
        assert r["n_known"] == sum(t in counts for t in tokens)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert -1e9 < r["score"] < 0 and r["bits_per_byte"] > 0
    long_text = next(r for r in rows if r["doc_id"] == 9002)
    assert long_text["bits_per_byte"] < 0.2  # adapts to a text that repeats
    assert context_mixing.score_texts(docs.limit(0)).collect() == []


def test_language_model_knows_the_order_of_words(spark):
    chance = random.Random(5)
    words = [f"w{n}" for n in range(300)]
    phrases = [" ".join(chance.choices(words, k=6)) for _ in range(150)]
    rows = [(n, " ".join(chance.choices(phrases, k=12))) for n in range(400)]
    held_out = [n for n in range(4000) if zlib.crc32(str(n).encode()) % 5 == 1]
    originals = [n for n in held_out if n < 400]
    copies = dict(zip(originals, (n for n in held_out if n >= 1000), strict=False))
    shuffled = [(copies[n], " ".join(chance.sample(rows[n][1].split(), 72))) for n in originals]
    found = {r["doc_id"]: r for r in context_mixing.score_texts(spark.createDataFrame(rows + shuffled, "doc_id long, text string")).collect()}
    assert len(originals) > 30 and all(found[n]["held_out"] and found[copies[n]]["held_out"] for n in originals)
    for n in originals:
        assert found[copies[n]]["score"] < found[n]["score"] - 30
        assert found[n]["score"] > found[n]["base_score"]


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    one, other = ({r["doc_id"]: r["score"] for r in context_mixing.score_texts(d).collect()} for d in (docs, docs.repartition(7)))
    assert one.keys() == other.keys()
    assert all(math.isclose(one[n], other[n], rel_tol=1e-6) for n in one)


def test_token_probabilities_of_a_position_sum_to_one():
    table = np.zeros((context_mixing.CONTEXTS, 1 << context_mixing.TABLE_BITS, 2), np.float32)
    context_mixing.add_counts(table, [b"abc", b"abd", b"xyz"], np.array([5, 3, 2]))
    mixer = context_mixing.Mixer.fresh()
    total = 0.0
    codes = [bytes([b]) for b in range(256)]
    at = context_mixing.Positions([b"ab"])
    for code in codes:
        p = 1.0
        at.symbol[0] = code[0]
        for n in range(8):
            bit, one, *_ = mixer.predict(at, n, table)
            p *= one[0] if bit[0] else 1 - one[0]
        total += p
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_log_gamma():
    x = np.array([1, 1.5, 2, 7.3, 100, 1e5, 1e7])
    assert np.allclose(context_mixing.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


# --- pipeline ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], FOLDER)))
    return out


def test_stages_keep_their_promises(spark, stages):
    docs, clean, single, cut, mix, codes = stages
    assert clean.columns == single.columns == cut.columns == mix.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    want, _ = brute_components(list(rows.items()))
    assert {r["doc_id"] for r in single.collect()} == {i for i in want if want[i] == i}
    words, gone = brute_repeats([(r["doc_id"], r["text"]) for r in single.collect()])
    left = {r["doc_id"]: (r["text"] or "").encode().split() for r in cut.collect()}
    assert all(left.get(i, []) == [w for n, w in enumerate(ws) if n not in gone.get(i, ())] for i, ws in words.items())
    assert codes.count() == mix.count() > 0
    assert {r["doc_id"] for r in mix.collect()} <= set(left)
