from functools import reduce
from operator import add

import numpy as np
import pytest

from weir.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v, _, _ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            scored = sorted((-reduce(add, (w * v).tolist(), 0.0), j) for j, w in ok if j != i)[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


def vectors(n):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[1::7] = x[0]  # a common vector
    rows = [(k, x[k].tolist(), "s", 0) for k in range(n)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 15, []]
    return rows + [(20 * (n + k), v, "s", 0) for k, v in enumerate(bad)] + [(None, [1.0] * 16, "s", 0)]


def ask(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_exact_while_all_are_reranked(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rows = vectors(450)
    got, want = ask(spark, rows, k=20), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want[q]], abs=1e-12)


@pytest.mark.parametrize("cells", [256, 1])
def test_only_counts_are_broadcast(spark, monkeypatch, cells):
    """Copies of the blocks are more than the planner counts, so the driver must not collect them; cells of one part, or of several."""
    for name, value in (("BLOCK", 50), ("QUERY_BLOCK", 4), ("CELLS", cells), ("CELL", 3)):
        monkeypatch.setattr(ann, name, value, raising=False)
    plans, written = {}, ann.common.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(ann.common, "written", noted)
    rows = vectors(450)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = ann.search(df, df.filter("vec_id % 20 = 0"), k=20)
    assert "SortMergeJoin" in plans["ann-asks"] and "Broadcast" not in plans["ann-asks"]
    last = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in last and "copies" in last
    got, want = {}, brute(rows, 20)
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: {x[1] for x in w} for q, w in want.items()}


def test_recall_by_table_scans(spark):
    rows = vectors(3000)
    got, want = ask(spark, rows, k=20), brute(rows, 20)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_recall_on_other_rows(spark):
    """Most vectors differ little from one vector, so they have the same codes unless what remains of them is coded."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = rng.random(3000) < 0.8
    x[near] = x[0] + 1e-4 * rng.standard_normal((int(near.sum()), 16))
    rows = [(n, v, "s", 0) for n, v in enumerate(x.astype(np.float32).tolist())]
    got, want = ask(spark, rows, k=20), brute(rows, 20)
    assert sum(len({v[1] for v in got[q]} & {v[1] for v in want[q]}) for q in want) >= 0.97 * 20 * len(want)


def test_queries_left_open_are_asked_again(spark, monkeypatch):
    """With so few vectors scored exactly, others may belong to the nearest; all that may are scored then."""
    monkeypatch.setattr(ann, "BLOCK", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rows = vectors(3000)
    got, want = ask(spark, rows, k=20, rerank=20), brute(rows, 20)
    assert {q: [x[0] for x in v] for q, v in got.items()} == {q: [x[0] for x in v] for q, v in want.items()}
    assert sum(len({v[1] for v in got[q]} & {v[1] for v in want[q]}) for q in want) >= 0.97 * 20 * len(want)


def test_recall_of_the_registered_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {(r[0], r[2]) for r in con.execute(queries.OP4_SQL).fetchall()}
    got = {(r.query_id, r.vec_id) for r in queries.op4_nearest(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.5], "", 0), (0, [1.0, 0.5], "", 0), (1, [0.5, 1.0], "", 0), (1, [2.0, 1.0], "", 0)]
    got = ask(spark, rows, k=5)
    assert [x[1] for x in got[0]] == [1, 1, 1, 1] and sorted({x[2] for x in got[0]}) == [1.0, 2.5]


def test_few_and_none(spark):
    assert ask(spark, vectors(3)[:3], k=20) == brute(vectors(3)[:3], 20)
    assert ask(spark, [], k=20) == {}
    assert ask(spark, [(0, None, "", 0)], k=20) == {}


def test_score_aware_loss_lowers_the_parallel_error():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 32))
    parallel = []
    for share in (0.0, 0.4):
        q = ann.fit(x, share, rounds=4)
        r = x - q.decode(q.encode(x))
        parallel.append((((r * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2).mean())
    assert parallel[1] < 0.5 * parallel[0]
