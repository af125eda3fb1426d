import random
from collections import defaultdict

import pytest

from weir.llm import mixing


def fill(sizes, weights, epochs=3.0):
    """Clamps and redistributes until no source is above."""
    target, capped = {}, set()
    budget = sum(sizes.values())
    while True:
        left = budget - sum(sizes[s] * epochs for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        target = {s: sizes[s] * epochs if s in capped else left * weights[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] >= sizes[s] * epochs}
        if not over:
            return target
        capped |= over


def documents(rng, n=400):
    out = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "a", "a", "b", "B", "é", None, "c", "d"])
        out.append((k, rng.choice([None, "", " \t", "x" * 50]) if rng.random() < 0.05 else " ".join("w" for _ in range(rng.randint(1, 60))), source, 7, 8.0))
    return out + out[:5] + [(None, "null id words", "a", 1, 1.0), (1, "other text of id 1", "b", 1, 1.0)]


SCHEMA = "doc_id long, text string, source string, size int, target double"


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    data = documents(random.Random(seed))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(data)
    sizes = defaultdict(int)
    for _, text, source, _, _ in data:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    taken = defaultdict(int)
    by_source = {r.source_size: r.target for r in rows}
    for r in rows:
        assert r.taken in {0, r["size"], 2 * r["size"], 3 * r["size"]}
    for s in sizes:
        assert by_source[sizes[s]] == pytest.approx(want[s])
    text_source = defaultdict(list)
    for d, text, source, _, _ in data:
        text_source[d, len((text or "").split())].append(source)
    for r in rows:
        taken[text_source[r.doc_id, r["size"]][0]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61, (s, taken[s], want[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_documents_follow_the_mix(spark):
    data = documents(random.Random(3))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    counted = sorted((str(r.doc_id), r.taken) for r in mixing.mix(df).collect() if r.taken)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    by = defaultdict(int)
    for r in out.collect():
        by[str(r.doc_id)] += len((r.text or "").split())
    want = defaultdict(int)
    for d, n in counted:
        want[d] += n
    assert {k: v for k, v in by.items() if v} == dict(want)


def test_empty_and_single(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None, 0, 0.0)], SCHEMA)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)]


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.createDataFrame(documents(random.Random(4)), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_given_weights(spark):
    df = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2], 0, 0.0) for k in range(40)], SCHEMA)
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    rows = mixing.mix(df, weights).collect()
    assert sum(r.taken for r in rows if r.doc_id % 2) == 0 and sum(r.taken for r in rows) == 400


def test_fractional_epochs_and_the_salted_join(spark, monkeypatch):
    rows = [(k, "w " * 10, "ab"[k % 20 == 0], 0, 0.0) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    want = sorted(map(str, mixing.mix(df, weights, max_epochs=2.5).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.mix(df, weights, max_epochs=2.5).collect()
    assert sorted(map(str, got)) == want
    assert {r.target for r in got if r.source_size == 200} == {500.0} and sum(r.taken for r in got if r.source_size == 200) == 500


def test_many_sources(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 7), f"s{k % 3000:05d}", 0, 0.0) for k in range(6000)], SCHEMA).repartition(5)
    sizes = defaultdict(int)
    for k in range(6000):
        sizes[f"s{k % 3000:05d}"] += 1 + k % 7
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    for r in mixing.mix(df, keep=("doc_id",)).select("doc_id", "target").collect():
        assert r.target == pytest.approx(want[f"s{r.doc_id % 3000:05d}"])
