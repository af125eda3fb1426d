import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weir.llm import common, langid, quality, queries

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def packed(texts):
    return common.utf8(pa.array(texts, pa.large_string()))


def test_held_out(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(200), -5, None]], "doc_id long").withColumn("h", common.held_out()).collect()
    assert all(r.h == (held(r.doc_id) if r.doc_id is not None else True) for r in rows)


def test_language_accuracy_on_held_out(spark):
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(rows) == len(docs)
    judged = [(rows[d["doc_id"]], d) for d in docs if held(d["doc_id"])]
    assert all(r.held_out for r, _ in judged)
    assert np.mean([r.lang_pred == d["lang"] for r, d in judged]) >= 0.97
    assert np.mean([r.rejected for r, _ in judged]) <= 0.02
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_logits_against_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BUCKETS, 3)).astype(np.float32), rng.standard_normal(3))
    texts = ["", "a", "ab", "abc", "Hello wörld", "x" * 500, None, "日本 語", "q\tR\n s" * 40, ""]
    raw, at = packed(texts)
    for segment in (1 << 21, 37):
        monkeypatch.setattr(common, "SEGMENT_BYTES", segment)
        z = m.logits(raw, at)
        for k in range(len(texts)):
            grams = np.concatenate(langid.ngram_buckets(raw[at[k] : at[k + 1]]))
            want = m.table[grams].sum(axis=0) / max(1, len(grams)) + m.bias
            assert np.allclose(z[k], want, atol=1e-3)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score double, rejected string"
    known = [(k, ("the cat and dog " if k % 2 else "der hund und katze ") * 5, "en" if k % 2 else "de", 0.0, "x") for k in range(60)]
    odd = [(100, None, "en", 0.0, ""), (101, "", "en", 0.0, ""), (102, "12 34 !?", None, 0.0, ""), (103, "é", None, 0.0, ""), (104, "the dog", None, 0.0, ""), (104, "the dog", None, 0.0, ""), (None, "der hund " * 20000, None, 0.0, "")]
    df = spark.createDataFrame(known + odd, schema)
    model = langid.fit(df)
    out = langid.identify(df, model).collect()
    pred = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == 67 and [pred[k] for k in (100, 101, 102)] == ["und"] * 3 and pred[103] in ("de", "en") and pred[104] == "en" and pred[None] == "de"
    none = langid.identify(df, langid.fit(df.filter("lang = 'xx'"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}
    assert langid.identify(df.limit(0), model).count() == 0


def test_a_language_that_was_not_learned_is_rejected():
    docs = [d for d in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist() if d["text"] and d["lang"]][:5000]
    for out in ("fr", "de"):
        learned = [d for d in docs[:2500] if d["lang"] != out]
        m = langid.train([d["text"] for d in learned], [d["lang"] for d in learned])
        kept, strange = ([m.predict(*packed([d["text"] for d in some]))[2] >= m.threshold] for some in ([d for d in docs[2500:] if d["lang"] != out], [d for d in docs[2500:] if d["lang"] == out]))
        assert np.mean(kept) >= 0.99 and np.mean(strange) <= 0.1


def test_descent_against_plain_steps():
    """The same steps in plain Python lists, one coordinate at a time."""
    rng = np.random.default_rng(2)
    bags = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5).astype(np.float32) / 5, int(rng.integers(0, 3))) for _ in range(12)]
    table, bias = langid._descend(bags, 3, 2, np.random.default_rng(9))
    rng = np.random.default_rng(9)
    e = (rng.standard_normal((langid.BUCKETS, langid.DIM)) * 0.1)[:40].tolist()
    w, b = (rng.standard_normal((langid.DIM, 3)) * 0.3).tolist(), [0.0] * 3
    done = 0
    for _ in range(2):
        for k in rng.permutation(12):
            ids, share, y = bags[k]
            v = [sum(float(s) * e[i][d] for i, s in zip(ids, share)) for d in range(langid.DIM)]
            z = [sum(v[d] * w[d][c] for d in range(langid.DIM)) + b[c] for c in range(3)]
            top = [np.exp(x - max(z)) for x in z]
            g = [t / sum(top) - (c == y) for c, t in enumerate(top)]
            rate = langid.RATE * (1 - done / 24)
            done += 1
            back = [sum(w[d][c] * g[c] for c in range(3)) for d in range(langid.DIM)]
            for c in range(3):
                b[c] -= rate * 0.01 * g[c]
                for d in range(langid.DIM):
                    w[d][c] -= rate * 0.1 * v[d] * g[c]
            for i, s in zip(ids, share):
                for d in range(langid.DIM):
                    e[i][d] -= rate * float(s) * 5**0.5 * back[d]
    assert np.allclose(table[:40], np.array(e) @ np.array(w), atol=1e-3) and np.allclose(bias, b, atol=1e-4)


def test_many_languages_and_long_texts(spark, monkeypatch):
    rows = [(k, f"w{k % 260}x " * 30, f"l{k % 260}") for k in range(1300)] + [(9999, "w1x " * 200_000, "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df).langs) == 260
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 259)
    with pytest.raises(ValueError):
        langid.fit(df)


def test_quality_on_held_out(spark):
    rows = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    judged = [(rows[d].score, rows[d].predicted, y) for d, y in labels.items() if held(d)]
    good = [s for s, _, y in judged if y == 1]
    bad = [s for s, _, y in judged if y == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert np.mean([p == y for _, p, y in judged]) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_edges(spark):
    schema = "doc_id long, text string, score double, predicted int, features string"
    rows = [(k, "Plain words here. " * 9 if k % 3 else "###!! $$ %% " * 9, 0.0, 0, "") for k in range(90)] + [(500, None, 0.0, 0, ""), (501, "", 0.0, 0, ""), (500, None, 0.0, 0, ""), (None, "word " * 50000, 0.0, 0, "")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(90)] + [(3, 0, 0), (7, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(df, quality.fit(df, labels)).collect()
    assert len(out) == len(rows) and all(r.predicted == int(r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 90)
    same = {r.score for r in out if r.doc_id in (500, 501)}
    assert len(same) == 1
    flat = quality.score(df, quality.fit(df, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


def test_flattened_trees_against_a_walk():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 7))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.train(x, y, trees=30)
    got = forest.score(x)
    for k in range(0, 600, 37):
        total = forest.base
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.left[node] if x[k, forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert got[k] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == y).mean() > 0.97


def test_training_against_exhaustive_search():
    """Every cut of every statistic tried by plain loops; rows to leaves by the same rule."""
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((90, 3)), 1)
    y = ((x[:, 1] > 0.2) ^ (rng.random(90) < 0.1)).astype(float)
    forest = quality.train(x, y, trees=4, depth=2)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(3)]
    total = [float(np.log(y.mean() / (1 - y.mean())))] * 90

    def grow(rows, g, h, depth):
        G, H = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = None
        for f in range(3) if depth else ():
            for c in cuts[f]:
                low = [r for r in rows if x[r, f] <= c]
                if quality.LEAST_ROWS <= len(low) <= len(rows) - quality.LEAST_ROWS:
                    a, b = sum(g[r] for r in low), sum(h[r] for r in low)
                    gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, c)
        if best is None:
            return dict.fromkeys(rows, -quality.RATE * G / (H + 1))
        low = [r for r in rows if x[r, best[1]] <= best[2]]
        return grow(low, g, h, depth - 1) | grow([r for r in rows if r not in set(low)], g, h, depth - 1)

    for _ in range(4):
        p = [1 / (1 + np.exp(-t)) for t in total]
        value = grow(list(range(90)), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 2)
        total = [t + value[r] for r, t in enumerate(total)]
    assert np.allclose(forest.score(x), [1 / (1 + np.exp(-t)) for t in total], atol=1e-9)


def test_statistics_against_plain_counts():
    texts = ["Hello WORLD, this is it.\nThis is it.\n", "a!! b!! c", "", "x | y | z", "É é"]
    x = quality.statistics(*packed(texts))
    col = {n: k for k, n in enumerate(quality.FEATURES)}
    for t, row in zip(texts, x):
        words = t.split()
        assert row[col["log_words"]] == pytest.approx(np.log1p(len(words)))
        assert row[col["bang"]] == pytest.approx(t.count("!") / max(1, len(t.encode())))
        assert row[col["distinct_words"]] == pytest.approx(len({w.translate({c: c + 32 for c in range(65, 91)}) for w in words}) / len(words) if words else 1)
    assert x[1, col["marked_words"]] == pytest.approx(2 / 3)
