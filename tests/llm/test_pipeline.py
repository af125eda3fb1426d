import hashlib
import importlib
import itertools
import math
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weir.llm import common, langid, quality, queries, tokens

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == names
        if name != "source_mixing":
            assert after.exceptAll(docs).count() == 0
        counts.append(after.count())
        docs = after
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = docs.count()
    rows = packed.collect()
    assert sum(r.piece == 0 for r in rows) == want
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def plain_run(spark):
    """All stages row by row in plain Python; only the two fitted models are the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fit(docs, learn=~common.held_out())

    def language_fits(r):
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        grams = np.concatenate(langid.ngram_buckets(raw)) if len(raw) > 1 else np.zeros(0, int)
        z = sorted(model.table[grams].sum(axis=0, dtype=float) / max(1, len(grams)) + model.bias)
        return any(c.isalpha() for c in r["text"] or "") and z[-1] - z[-2] >= model.threshold

    rows = [r for r in rows if language_fits(r)]
    kept = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    forest = quality.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"), learn=~common.held_out())

    def good(r):
        x = quality.statistics(*common.utf8(pa.array([r["text"]], pa.large_string())))[0]
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + math.exp(-total)) >= 0.3

    rows = [r for r in rows if good(r)]
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for r in rows:
        words = re.findall("[^ \t-\r]+", (r["text"] or "").translate(lower))
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if x == high else x for d, x in root.items()}
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    sizes, by_source = {}, {}
    for r in rows:
        r["size"] = len(re.findall("[^ \t-\r]+", r["text"] or ""))
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in by_source[s]) for s in order}
    weights, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / max(1, sum(weights[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * weights[s] >= 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = []
    for s in order:
        target = 3 * sizes[s] if s in full else level * weights[s]
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        rest, upto = target - whole * sizes[s], 0
        for r in sorted(by_source[s], key=lambda r: (hashlib.md5(f"17:{r['doc_id']}:{r['text'] or ''}".encode()).hexdigest(), r["doc_id"])):
            upto += r["size"]
            taken += [r] * min(3, whole + (rest > 0 and upto - r["size"] / 2 <= rest))
    library = Tokenizer.from_file(tokens.default_path())
    out = []
    for r in taken:
        ids, at, piece = library.encode(r["text"] or "", add_special_tokens=False).ids + [0], 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 2048 + 1 if at == 0 else 2048
            out.append((r["doc_id"], piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    return out


def test_run_against_a_plain_version(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(plain_run(spark))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(placed))]
        assert [o for o, _ in sorted(placed)] == ends[:-1] and ends[-1] <= 2048


#: Names that operators use inside, or that others give to their results.
INNER = "score rejected predicted id repeats size gone deal turn rep root sequence_id offset range at bucket text_col length held_out lang_pred target taken component_id n draw kind slot grp token x0 x1 k0 c0 path value label_id made".split()


def test_stages_keep_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(INNER)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert [out.first()[c] for c in INNER] == list(range(len(INNER)))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def odd_folder(spark, tmp_path, empty):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, and columns of clashing names; or none."""
    known = [(k, ("The quick brown fox jumps over it. " if k % 2 else "Der kleine Hund sucht seinen Ball. ") * (k % 5 + 1) + f"w{k}", "en" if k % 2 else "de", f"s{k % 3}", 3) for k in range(60)]
    odd = [(None, None, None, None, None), (100, None, None, None, None), (101, "", "en", "s0", 0), (102, "x", None, None, 1), (103, "long words here " * 320_000, "en", "s1", 1), (104, "same text", "en", "s2", 1), (104, "same text", "en", "s2", 1), (105, "same text", None, "s2", 1)]
    extra = ", ".join(f"`{c}` int" for c in INNER)
    rows = [] if empty else [r + (None,) * len(INNER) for r in known + odd]
    path = str(tmp_path / ("empty" if empty else "odd"))
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    labels = [] if empty else [(k, k % 2, 0) for k in range(60)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [] if empty else [(k, [float(k % 7), 1.0, float(k)], None) for k in range(40)] + [(None, None, None), (60, [None, 1.0, 2.0], 1), (80, [0.0, 0.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    pages = [] if empty else [(1, None, None), (None, "https://www.example.com/en/x", ""), (2, "", None), (2, "no scheme", None), (2, "no scheme", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("empty", [False, True])
def test_registered_queries_on_odd_tables(spark, tmp_path, empty):
    path = odd_folder(spark, tmp_path, empty)
    rows = {"op1_url_filter": 5, "op4_nearest": 40 if empty else 2 * 20, "op5_packing": None}
    for name, query in queries.QUERIES.items():
        got = query(spark, path).collect()
        want = rows.get(name, 68)
        assert (not got) if empty else want is None or len(got) == want, name
    got = corpus_pipeline.run(spark, path).collect()
    assert (not got) if empty else all(r.length >= 1 for r in got)


def test_registry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("weir.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "weir.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert not any(name.startswith("op") for name in entry.queries()) and "pipeline" not in entry.queries()
