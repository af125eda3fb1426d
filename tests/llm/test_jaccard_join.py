import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weir.llm import common, jaccard_join
from weir.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rep string, token int"


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets, root, by = [shingles(t) for _, t in docs], {d: d for d, _ in docs}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += 1
            by[x].append(k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(docs[k][0]), find(docs[j][0])))
                root[b] = a
    return {d: (len(s), find(d)) for (d, _), s in zip(docs, sets)}


def families(seed):
    rng = random.Random(seed)
    words, docs = [f"w{k}" for k in range(300)], []
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 30)):
            d = list(base)
            for _ in range(rng.randint(0, max(1, len(d) // 25))):
                d[rng.randrange(len(d))] = rng.choice(words)
            d = d + passage if rng.random() < 0.4 else d
            docs.append(" ".join(passage + d if rng.random() < 0.2 else d))
    docs += ["", None, " \t", "A b", "a\nB", "É b", "é b", "long " + " ".join(f"x{k}" for k in range(30000))]
    rng.shuffle(docs)
    return list(enumerate(docs))


def found(spark, docs):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA).repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 50)
    monkeypatch.setattr(jaccard_join, "LEAST_COUNT", 3)
    docs = families(3)
    assert found(spark, docs) == brute(docs)


def test_matrix_alone_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 1)  # no pair is compared within a group
    monkeypatch.setattr(jaccard_join, "SEEDS", 2)
    monkeypatch.setattr(jaccard_join, "QUERIES", 3)
    monkeypatch.setattr(jaccard_join, "CELLS", 2)  # tokens are met in blocks
    monkeypatch.setattr(jaccard_join, "DEALT", 5)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    docs = families(4)
    assert found(spark, docs) == brute(docs)


def test_threshold_is_exact(spark):
    # 9 shingles each; 8 shared of 10 is 0.8, 7 of 11 isn't
    a = [f"a{k}" for k in range(13)]
    docs = [(1, " ".join(a)), (2, " ".join([*a[:-1], "z"])), (3, " ".join([*a[:-2], "y", "x"]))]
    assert found(spark, docs) == brute(docs) and brute(docs)[2][1] == 1 and brute(docs)[3][1] != 1 or found(spark, docs)[3][1] in (1, 3)


def test_repeated_null_empty(spark):
    rows = [(1, "a b", "", 0), (1, "a b", "", 0), (None, "a b", "", 0), (0, None, "", 0), (2, "A  B", "", 0), (3, "", "", 0)]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == [("0", 0, "0"), ("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3"), ("None", 1, "None")]
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "3", "None"] and kept.columns == ["doc_id", "text", "rep", "token"]


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (7, 6), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("segment", [64, 1 << 21])
def test_shingle_sets_follow_the_words(segment, monkeypatch):
    monkeypatch.setattr(common, "SEGMENT_BYTES", segment)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB \t\n\x0b\x1c\x85 é") for _ in range(rng.randint(0, 120))) for _ in range(300)] + [None, "", "x y " * 200]
    got = common.shingle_sets(pa.array(texts))
    names = {}
    for t, s in zip(texts, got):
        want = shingles(t)
        assert len(want) == len(s)
        for x in want:
            names.setdefault(x, set()).update(s.tolist()) if len(want) == 1 else None
    assert all(len(v) == 1 for v in names.values())
    again = common.shingle_sets(pa.array(texts[::-1]))[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(got, again))


def test_registered_query_against_sql(spark):
    import duckdb

    from weir.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op7_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(con.execute(queries.OP7_SQL).fetchall())


def test_the_sql_splits_words_as_the_operator_does(spark, tmp_path):
    import duckdb

    from weir.llm import queries

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\x0b\x0c\r\n\t \x1c\x85é") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "\r\x0b", "a\rb\x0bc\x0cd e f g", "a b c d e f g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op7_jaccard_join(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(con.execute(queries.OP7_SQL).fetchall())


def test_unions_bound_what_members_share():
    import numpy as np

    assert jaccard_join.linked(np.int64(80), np.int64(100), np.int64(80)) and not jaccard_join.linked(np.int64(79), np.int64(100), np.int64(80))
