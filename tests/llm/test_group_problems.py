import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import consensus, groups, mixing, queries
from palimpsest.operators import ordering

AT = datetime(2026, 1, 1)


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(25)] + [(900, 900)] + [(700, 701 + i) for i in range(40)]
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    wanted = union_find(edges)
    assert got.keys() == wanted.keys()
    assert len(set(got.values())) == len(set(wanted.values())) == len({(got[x], wanted[x]) for x in got})
    assert groups.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_related_rows(spark):
    rows = [
        (1, "en-de_001_clean", "One text", "Ein Text", "dev"), (2, "en_de/1/combo", "other", "anders", " TEST"), (3, "en-fr_007_x", "ONE  TEXT", "Un texte", None), (4, "fr-en_2_a", "Seul", "Alone", "dev"),
        (5, "fr-en_2_b", None, "", "DEV "), (6, None, None, None, "test"), (7, "xx", None, None, "dev"), (1, "en-de_001_clean", "One text", "Ein Text", "dev"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "idx bigint, id string, source string, reference string, split string, root string")
    assert sorted(r.idx for r in groups.broken_groups(df).collect()) == [1, 2, 3]
    dealt = groups.assign_splits(df, {"train": 0.5, "test": 0.5}).collect()
    assert len(dealt) == 7 and len({(r.root, r.new_split) for r in dealt}) == len({r.root for r in dealt})
    assert groups.broken_groups(df.limit(0)).count() == 0


def test_prefix_sums(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(9)) for k in range(400)]
    df = spark.createDataFrame(rows, "k bigint, g string, v bigint")
    got = ordering.prefix_sums(df, ["g"], F.xxhash64("k"), "v").withColumn("h", F.xxhash64("k")).collect()
    assert len(got) == 400
    for name in ("a", "b", None):
        total = 0
        for r in sorted((r for r in got if r.g == name), key=lambda r: r.h):
            assert r.before == total
            total += r.v


def test_consensus(spark):
    rng = random.Random(6)
    skill = {"good": 0.97, "fine": 0.9, "fair": 0.85, "poor": 0.6, "bad": 0.5}  # as unlike as in the data
    rows, wrong = [], set()
    for item in range(120):
        truth = "" if item % 6 == 0 else f"text {item}"
        for name, p in skill.items():
            said = truth if rng.random() < p else (f"{rng.choice(["long", "cut", "mixed"])} {truth} {item}" if rng.random() < 0.8 else "")
            rows.append((item, name, said, AT, AT, "x"))
            if said != truth:
                wrong.add((item, name))
    rows += [(0, "good", "old", datetime(2025, 1, 1), AT, "x"), (500, "good", "e\u0301", AT, AT, "x"), (500, "fine", " é ", AT, AT, "x"), (500, "poor", None, AT, AT, "x"), (500, None, "z", AT, AT, "x"), (None, "good", "q", AT, AT, "x")]
    df = spark.createDataFrame(rows, "idx bigint, silver_model string, silver_extracted_translation string, run_at timestamp, loaded_at timestamp, label string")
    got = {(r.idx, r.silver_model) for r in consensus.dissenting_votes(df).collect()}
    assert {x for x in got if x[0] == 500} == {(500, "poor"), (500, None)}
    rest = {x for x in got if x[0] != 500}
    # no worse than a vote weighted by the true skills, which the model has to find out
    weighted = set()
    for item in range(120):
        votes = {r[1]: r[2] for r in rows if r[0] == item and r[2] != "old"}
        support = {}
        for name, said in votes.items():
            support[said] = support.get(said, 0) + math.log(skill[name] / (1 - skill[name]))
        best = max(support, key=lambda said: support[said])
        weighted |= {(item, name) for name, said in votes.items() if said != best}
    assert len(rest ^ wrong) <= len(weighted ^ wrong) + 4
    table = {r.silver_model: r for r in consensus.reliability(df).collect()}
    assert min(table[n].reliability for n in ("good", "fine", "fair")) > max(table[n].reliability for n in ("poor", "bad")) and table["good"].low <= table["good"].reliability <= table["good"].high
    assert 0 < consensus.krippendorff(df).first().alpha < 1
    assert consensus.dissenting_votes(df.limit(0)).count() == 0


def test_digamma(spark):
    got = spark.createDataFrame([(1.0,), (0.5,), (10.0,)], "x double").select(consensus.digamma(F.col("x")).alias("d")).collect()
    assert [round(r.d, 6) for r in got] == [-0.577216, -1.96351, 2.251753]


def test_mixture(spark):
    rng = random.Random(8)
    words = ["market", "bridge", "harbour", "letter", "garden"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))), rng.choice(["big", " Big", "BIG", "small_one", "none", None])) for k in range(300)]
    docs += [(900, None, "big"), (901, "", "small-one")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small-one", 0.6, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    used = {r.doc_id: r for r in mixing.mixture(frame, targets).collect()}
    report = {r.source: r for r in mixing.mixture_report(frame, targets).collect()}
    encode = mixing._encoding(mixing.VOCABULARY).encode_ordinary
    plain = {k: (s or "").strip().lower().replace("_", "-") for k, _, s in docs}
    assert all(r.n_tokens == len(encode(next(t for k, t, _ in docs if k == i))) for i, r in used.items())
    assert all(r.copies <= {"big": 1, "small-one": 2}[plain[i]] for i, r in used.items())
    for source, row in report.items():
        mixed = sum(r.n_tokens * r.copies for i, r in used.items() if plain[i] == source)
        assert row.mixed_tokens == mixed
    total = sum(r.mixed_tokens for r in report.values())
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["absent"].actual_share == 0
    size = sum(r.have_tokens for r in report.values())
    budget = min(0.3 * size, report["big"].have_tokens)
    assert abs(report["big"].mixed_tokens - budget) <= 20 and total > 0
    assert mixing.mixture(frame.limit(0), targets).count() == 0 and mixing.mixture_report(frame, targets.limit(0)).count() == 0


def test_names():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9)} <= queries.QUERIES.keys() and "p8_mixture" in queries.QUERIES and queries.SQL.keys() <= queries.QUERIES.keys()
