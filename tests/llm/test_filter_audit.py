"""The filter audit against applying the filters one after another; its SQL is in test_oracle.py."""

import random
from itertools import permutations

from geoaffinity.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string, digest string"
LABELS = "doc_id long, quality int, toxic int, good string"


def fails(rows):
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = t.encode().split()
        out.append(
            {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
            }
        )
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = fails(rows)
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                steps.append(
                    (
                        part, "".join(order), step, len(left), len(gone), sum(d[1][f] for d in mine) - len(gone),
                        sum(sum(d[1].values()) == 1 and d[1][f] for d in mine),
                        sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f,
                    )
                )
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    marks = spark.createDataFrame([(*r, "z") for r in labels], LABELS)
    return sorted(map(tuple, filter_audit.audit_filters(docs, marks).collect()))


def test_equals_filtering_one_after_another(spark):
    chance = random.Random(2)
    rows = []
    for i in range(150):
        words = chance.choice([3, 150, 199, 200, 260])
        kinds = chance.choice([5, 99, 100, 130, 1000])
        text = " \n".join(f"{chance.choice('aB')}{chance.randrange(kinds)}é" for _ in range(words))
        rows.append((i, text + chance.choice(["", "", " 100%", " "]), chance.choice(["en", "de", None, ""])))
    rows += [(i, rows[i % 7][1], "en") for i in range(200, 240)]
    rows += [(None, rows[3][1], "fr"), (None, rows[3][1], None), (5, None, "en"), (6, "", "de"), (7, None, "de")]
    rows += [rows[1], rows[1], (1, rows[1][1], "other"), (300, "x " * 200_000, "long"), (301, "UPPER" * 50_000, "long")]
    labels = [(i, chance.choice([0, 1, None]), chance.choice([0, 1, None])) for i in range(0, 260, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    rows = [(1, "a", "en"), (2, "a", "en")]
    assert audited(spark, rows, []) == brute(rows, [])


def test_least_squares_gives_shapley_values():
    chance = random.Random(5)
    for players in (1, 2, 3, 5):
        operator = filter_audit.shapley_operator(players)
        value = [0, *(chance.randrange(1000) for _ in range((1 << players) - 1))]
        orders = list(permutations(range(players)))
        for f in range(players):
            gains = 0
            for order in orders:
                before = sum(1 << g for g in order[: order.index(f)])
                gains += value[before | 1 << f] - value[before]
            assert len(orders) * sum(c * v for c, v in zip(operator[f], value, strict=True)) == gains
