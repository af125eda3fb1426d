import hashlib
import random

import numpy as np
import pytest

from weir.llm import fingerprint

SCHEMA = "doc_id long, text string, fingerprint string, at int"


def texts(rng, n):
    words = [f"w{k}" for k in range(3000)] + ["é🙂", "Ünï"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(n)]
    return made + [None, "", "a", "ab", "abc", "one two three four five", "x" * 9000]


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_pairs(spark, parts):
    made = texts(random.Random(1), 60)
    rows = [(k * k - 50, t, "f", 1) for k, t in enumerate(made)]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t, _, _ in rows), reverse=True)
    for k, (d, t) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[d]
        prints = [fingerprint.fingerprint(x, fingerprint.sketches([x])[0]) for x in (t, edited, after)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1])
        a, e, b = (set(fingerprint.parse(p)[1].tolist()) for p in prints)
        like = lambda x, y, p, q: len(x & y) / len(x | y) if x | y else float(p == q)
        assert r.near_edited == pytest.approx(like(a, e, t, edited)) and r.near_next == pytest.approx(like(a, b, t, after))


def test_sketch_is_the_fixed_fraction_of_all_shingles():
    from weir.llm import common
    import pyarrow as pa

    text = " ".join(f"t{k}" for k in range(20000))
    whole = common.shingle_sets(pa.array([text]))[0]
    sketch = fingerprint.sketches([text])[0]
    assert len(sketch) == (whole < np.uint64(2**64 // fingerprint.SCALE)).sum() and abs(len(sketch) / len(whole) - 1 / 8) < 0.01
    part = " ".join(f"t{k}" for k in range(2000))
    _, held = fingerprint.compare("", sketch, "x", fingerprint.sketches([part])[0])
    assert held == 1.0
    both = fingerprint.merge([fingerprint.fingerprint(t, fingerprint.sketches([t])[0]) for t in (text, part, "")])
    assert both.tolist() == sketch.tolist()


def test_repeated_null_and_single(spark):
    rows = [(1, "a", "", 0), (1, "a", "", 0), (None, "b", "", 0), (5, "c", "", 0)]
    out = fingerprint.edited_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "5", "None"]
    one = fingerprint.edited_pairs(spark.createDataFrame([(3, "abcdef", "", 0)], SCHEMA)).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert fingerprint.edited_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    plain = fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.fingerprint for r in plain}) == 3 and len(plain) == 4
