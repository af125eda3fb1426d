import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weir.llm import common, packing, queries, token_codec, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def weird(rng, n):
    alphabet = list(" \n\t\r\x00\x1c\x85\xa0\u2003\u3000ab'sé.!1×÷ªº-\\[`{~^ßΩ日🙂") + ["the", "in's", "''ll", "\n", "\n", " ", " ", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_chunks_encode_like_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 2000)
    encoder, texts = tokens.ChunkEncoder(tokens.default_path()), weird(random.Random(5), 20000)
    for k in range(0, len(texts), 500):
        got = encoder.encode(texts[k : k + 500])
        want = library.encode_batch(texts[k : k + 500], add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_special_tokens_as_text_on_demand(library):
    plain, other = tokens.ChunkEncoder(tokens.default_path()), tokens.ChunkEncoder(tokens.default_path(), special_as_text=True)
    text = "a <|endoftext|> b<|endoftext|>"
    strict = Tokenizer.from_file(tokens.default_path())
    strict.encode_special_tokens = True
    assert np.frombuffer(plain.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(other.encode([text])[0], "<u4").tolist() == strict.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(plain.encode([text])[0], "<u4") and 50256 not in np.frombuffer(other.encode([text])[0], "<u4")


def docs(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def some_rows():
    rng = random.Random(6)
    rows = [(k * 3, t, "x", 1) for k, t in enumerate(weird(rng, 150))]
    return rows + [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "word " * 30000, "x", 1), (1003, "a" * 5000, None, None), (1004, "same", "", 0)]


def test_token_files(spark, tmp_path, library, monkeypatch):
    for name, value in (("RANGE_TOKENS", 9000), ("FILE_TOKENS", 3000)):
        monkeypatch.setattr(token_codec, name, value)
    rows = some_rows()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_output(spark, docs(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    at = 0
    for d, text, _, _ in sorted(rows):
        ids = np.array(ids_of(library, text), "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "b", "", 0), (1, "a", "", 0), (1, "a", "", 0), (None, "n", "", 0)]
    out = queries.op6_token_output(spark, docs(spark, tmp_path, rows)).collect()
    assert sorted(r.start for r in out) == [0, 2, 4, 6] and {r.start for r in out if r.doc_id is None} == {0}


def test_empty_table(spark, tmp_path):
    path = docs(spark, tmp_path, [])
    assert queries.op5_packing(spark, path).count() == 0
    assert queries.op6_token_output(spark, path).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n, limit in ((2, 16), (40, 16), (40, 6), (300, 9), (1, 4)):
        counts = np.zeros(500, np.int64)
        counts[rng.choice(500, n, replace=False)] = np.maximum(1, (rng.pareto(0.4, n) * 3).astype(np.int64))
        lengths = token_codec.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(int)
        assert (lengths[counts == 0] == 0).all() and used.max() <= limit and sum(2.0**-x for x in used) <= 1
        if limit == 16 and n > 1:
            import heapq

            heap, cost = sorted(counts[counts > 0].tolist()), 0
            while len(heap) > 1:
                a = heapq.heappop(heap) + heapq.heappop(heap)
                cost += a
                heapq.heappush(heap, a)
            if max(used) < 16:
                assert cost == (counts * lengths).sum()


@pytest.mark.parametrize("limit", [12, 16, 18, 24])
def test_any_range_decodes(limit, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(limit)
    ids = np.minimum(rng.zipf(1.3, 150_000), 4000).astype(np.int64)
    packed = zlib.compress(token_codec.code_lengths(np.bincount(ids, minlength=5000), limit).tobytes())
    table = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([len(ids)])], ["doc_id", "n_tokens"])
    data = token_codec.write_file(table, ids, 5, packed, limit)
    f = token_codec.TokenFile(data)
    assert (f.ids() == ids).all()
    for lo, hi in ((0, 1), (63, 65), (65535, 65537), (70000, 149999), (149999, 150000), (10, 10), (149000, 999999)):
        assert (f.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        token_codec.TokenFile(data[:50] + b"\0\1" + data[52:])


def check_packing(rows, out, library, length=2048):
    bins, by = {}, {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    for d, text, _, _ in rows:
        ids, at = np.array(ids_of(library, text), "<u4"), 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= length
            assert r.length == length or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(bins)


def test_packing(spark, tmp_path, library):
    rows = some_rows()
    out = queries.op5_packing(spark, docs(spark, tmp_path, rows)).collect()
    total = sum(r.length for r in out)
    assert check_packing(rows, out, library) <= -(-total // 2048) + 1


def test_packing_is_near_the_bound_on_documents(spark):
    out = queries.op5_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length").toPandas()
    assert out["sequence_id"].nunique() <= 1.005 * -(-int(out["length"].sum()) // 2048) + 1


def test_packing_replaces_columns_of_its_own_names(spark):
    cut = spark.createDataFrame([(1, 5, 7, "d", "t", "g"), (2, 3, 7, "d", "t", "g")], "doc_id long, length long, sequence_id long, deal string, turn string, offset string")
    out = packing.pack(cut, length=8)
    assert out.columns == ["doc_id", "length", "deal", "turn", "sequence_id", "offset"] and sorted(r.offset for r in out.collect()) == [0, 5]


def test_bins_against_brute_force():
    rng = random.Random(8)
    for open_bins in (1, 3, 50):
        bins, open_, names = packing.Bins(64, open_bins), {}, 0
        for _ in range(2000):
            size = rng.randint(1, 64)
            name, offset = bins.place(size)
            fits = [f for f in open_.values() if f >= size]
            if fits:
                assert open_[name] == min(fits) and offset == 64 - min(fits)
                open_[name] -= size
            else:
                assert name == names and offset == 0
                names += 1
                if len(open_) >= open_bins and size < 64:
                    least = min(open_.values())
                    gone = {n for n, f in open_.items() if f == least}
                    held = {n for stack in bins.at for n in stack}
                    (closed,) = gone - held
                    del open_[closed]
                open_[name] = 64 - size
            open_ = {n: f for n, f in open_.items() if f}
            assert len(open_) <= open_bins and bins.open == len(open_)


def test_whole_pieces_are_kept_by_the_operator(spark):
    cut = packing.pieces(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), length=2)
    rows = sorted(packing.pack(cut, length=2).collect(), key=lambda r: r.piece)
    assert [len(r.ids) // 4 for r in rows] == [r.length for r in rows] and all(r.length <= 2 for r in rows)


def test_gathered_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"t": ["x" * n] * n}) for n in (0, 1, 5, 9, 0, 2)]
    got = list(common.gathered(iter(batches), 40))
    assert sum(b.num_rows for b in got) == 17 and len(got) < 6
