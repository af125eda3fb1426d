import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from weir.operators import fidelity, tenants as T
from weir.plans import policy

OUT = ["upsert_applied", "upsert_ignored_stale", "remove_applied", "remove_ignored_stale", "remove_already_removed"]


def event(seq, version, payload="p", kind="policy", tenant="t", provenance=None):
    return {"seq": seq, "tenant_id": tenant, "version": version, "kind": kind, "payload": payload, "provenance": provenance}


def outcomes(events):
    return [o for o, _ in T.replay(events)]


def test_versions():
    assert outcomes([event(1, 10), event(2, 9), event(3, 10)]) == ["upsert_applied", "upsert_ignored_stale", "upsert_ignored_stale"]
    assert outcomes([event(1, 12), event(2, 11, None), event(3, 13, None), event(4, 12), event(5, 13, None)]) == ["upsert_applied", "remove_ignored_stale", "remove_applied", "upsert_ignored_stale", "remove_already_removed"]
    assert outcomes([event(1, 5), event(2, 5, None)]) == ["upsert_applied", "remove_applied"]
    assert outcomes([event(1, 5, None), event(2, 5, None)]) == ["remove_applied", "remove_already_removed"]


def test_media_limits_share_the_version():
    got = list(T.replay([event(1, 3, "base"), event(2, 3, "m", "media"), event(3, 4, "m", "media", provenance="who"), event(4, 4, None, "media"), event(5, 4, None, "media"), event(6, 5, "m2", "media"), event(7, 6, "new")]))
    assert [o for o, _ in got] == ["upsert_applied", "upsert_ignored_stale", "upsert_applied", "remove_applied", "remove_already_removed", "upsert_applied", "upsert_applied"]
    slot = got[-1][1]
    assert (slot.policy, slot.limits) == ("new", None)
    (_, unknown), = T.replay([event(1, 7, None, "media")])
    assert unknown.version == 7 and not unknown.active


def test_unconditional_changes():
    s = T.Slot()
    T.remove(s)
    assert s.version == 1 and not s.active
    T.upsert(s, "p")
    assert (s.version, s.policy) == (2, "p")


def history(seed, n=300):
    rng = random.Random(seed)
    return [event(k, rng.randint(1, 12), None if rng.random() < 0.35 else f"p{k}", rng.choice(["policy", "media"]), f"t{rng.randint(0, 6)}") for k in range(n)]


def test_fold_equals_replay(spark):
    events = history(1)
    rows = spark.createDataFrame([tuple(e[c.split()[0]] for c in T.EVENTS.split(", ")) for e in events], T.EVENTS).repartition(5)
    folded = T.fold(rows).cache()
    got = {r.seq: (r.outcome, r.version) for r in folded.collect()}
    assert got == {e["seq"]: (o, v) for e, (o, v) in zip(events, [(o, s.version) for o, s in T.replay(events)])}
    report = T.import_report(folded).first().asDict()
    assert report == {o: outcomes(events).count(o) for o in T.OUTCOMES}
    last = {}
    for e, (_, s) in zip(events, T.replay(events)):
        last[e["tenant_id"]] = (s.version, s.policy, s.limits)
    assert {r.tenant_id: (r.version, r.policy, r.limits) for r in T.latest(folded).collect()} == last
    folded.unpersist()


def test_stream_equals_fold(spark, tmp_path):
    from weir.streaming.tenants import fold_stream

    events = history(2, 120)
    columns = [c.split()[0] for c in T.EVENTS.split(", ")]
    source = str(tmp_path / "in")
    query = None
    for part in range(3):
        rows = [tuple(e[c] for c in columns) for e in events[part * 40 : part * 40 + 40]]
        spark.createDataFrame(rows, T.EVENTS).coalesce(1).write.mode("append").parquet(source)
        if query is None:
            stream = spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
            query = fold_stream(stream).writeStream.format("memory").queryName("tenant_outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
    query.stop()
    got = {r.seq: (r.outcome, r.version) for r in spark.sql("SELECT * FROM tenant_outcomes").collect()}
    assert got == {e["seq"]: (o, v) for e, (o, v) in zip(events, [(o, s.version) for o, s in T.replay(events)])}


def test_stream_of_objects(spark, tmp_path):
    from weir.sources.derived import derived_objects
    from weir.streaming.tenants import defend_stream

    objects = derived_objects(spark, "/root/testdata/sf0.001").limit(40)
    objects.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(objects.schema).parquet(str(tmp_path / "in"))
    query = defend_stream(stream, policy.policy_table(spark), str(tmp_path / "out"), str(tmp_path / "c"), str(tmp_path / "audit"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40 and spark.read.parquet(str(tmp_path / "audit")).count() > 0


def test_signatures(spark):
    text = T.snapshot_payload("t", 4, policy.profile("standard", signature_rules=[{"name": "r", "pattern": b"\x01", "location": "FirstBytes", "limit": 3}]), {"actor": "a"})
    assert text.startswith('{"tenant_id":"t","version":4,"policy":{"minimum_reconstruction_level":"Structural","max_handler_duration_ms":10000') and '"signature_rules":[{"name":"r","pattern_hex":"01","location":{"FirstBytes":3}}]' in text
    assert T.media_payload("t", 1, {"audio_max_channels": 2}).endswith('"audio_max_channels":2},"provenance":null}') and T.snapshot_payload("a", 1, None) == '{"tenant_id":"a","version":1,"policy":null,"provenance":null}'
    ring = T.KeyRing({"new": T.Key(b"s1"), "old": T.Key(b"s2", 1000)}, 10000)
    sign = lambda key, p: hmac.new(key, p.encode(), hashlib.sha256).hexdigest()
    cases = [("new", sign(b"s1", "x"), 5, "verified_current"), ("new", sign(b"s2", "x"), 5, "rejected_invalid_signature"), ("old", sign(b"s2", "x"), 11000, "verified_in_grace"), ("old", sign(b"s2", "x"), 11001, "rejected_expired"), ("none", "", 5, "rejected_unknown_key"), (None, "", 5, "rejected_unknown_key")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, key_id string, digest string, now long, want string").withColumn("outcome", T.verification(F.lit("x"), F.col("key_id"), F.col("digest"), ring, F.col("now")))
    assert all(r.outcome == r.want for r in rows.collect())
    usage = {r.key_id: r for r in T.key_usage(rows.select("key_id", "outcome")).collect()}
    assert (usage["old"].seen, usage["old"].verified, usage["old"].verified_in_grace, usage["old"].rejected_expired) == (2, 1, 1, 1)


def test_signed_import(spark):
    events = [event(1, 1), event(2, 2), event(3, 3, None)]
    rows = spark.createDataFrame([tuple(e[c.split()[0]] for c in T.EVENTS.split(", ")) for e in events], T.EVENTS)
    out = T.signed_import(rows, F.col("seq") != 2)
    assert {r.seq: r.outcome for r in out.collect()} == {1: "upsert_applied", 2: "rejected_invalid_signature", 3: "remove_applied"}


def test_effective_policies(spark):
    limits = {"video_max_duration_secs": 5, "audio_max_channels": None}
    assert T.effective_policy(None, None, policy.STANDARD) is None
    assert T.effective_policy(None, limits, policy.STANDARD)["video"]["max_duration_secs"] == 5
    assert T.effective_policy(policy.STRICT, limits, policy.STANDARD)["audio"]["max_channels"] == 2 and T.effective_policy(policy.STRICT, None, policy.STANDARD) == policy.STRICT
    slots = spark.createDataFrame([("a", 1, "strict"), ("b", 2, None)], "tenant_id string, version long, policy string")
    objects = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "object_id int, tenant_id string")
    assert {r.object_id: r.policy_id for r in T.resolve(objects, slots).collect()} == {1: "strict", 2: "standard", 3: "standard", 4: "standard"}


def test_fidelity(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal(2000)
    for lag in (0, 7, -12):
        rows = [("c", 0, int(k), float(x[k]), float(x[k - lag] * 0.7 + 0.3) if 0 <= k - lag < 2000 else 0.3) for k in range(2000)]
        df = spark.createDataFrame(rows, "case_id string, channel int, pos long, reference double, estimate double")
        assert fidelity.shared_lag(df, most=20, window=1500).first().lag == lag
    y = 2 * x + 0.1 * rng.standard_normal(2000) + 5
    df = spark.createDataFrame([("c", 0, int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "case_id string, channel int, pos long, reference double, estimate double")
    a, b = x - x.mean(), y - y.mean()
    scale = a @ b / (a @ a)
    want = 10 * np.log10(scale**2 * (a @ a) / ((b - scale * a) @ (b - scale * a)))
    assert fidelity.si_sdr(df).first().si_sdr_db == pytest.approx(want, rel=1e-6)
    flat = spark.createDataFrame([(0.0, 0.0), (3.0, 1.0)], "a double, b double").select(fidelity.duration_error(F.col("a"), F.col("b")).alias("e"))
    assert [r.e for r in flat.collect()] == [0.0, 1.0]


def test_published_versions(spark, tmp_path):
    folder = "file://" + str(tmp_path / "slots")
    assert T.published(spark, folder) == (0, None)
    one = spark.createDataFrame([("a", 1)], "tenant_id string, version long")
    two = spark.createDataFrame([("a", 2), ("b", 1)], "tenant_id string, version long")
    assert T.publish(one, folder, 0) and not T.publish(two, folder, 0) and T.publish(two, folder, 1)
    version, slots = T.published(spark, folder)
    assert version == 2 and slots.count() == 2


def test_table_changes_equal_changes_one_by_one(spark):
    slots = [("a", 4, "p", "l", "w"), ("b", 2, None, None, None), ("c", 1, "q", None, "x")]
    changes = [(1, "a", "n", "z"), (2, "b", "m", None), (3, "a", None, None), (4, "d", None, None), (5, "b", "o", "y")]
    got = {r.tenant_id: tuple(r)[1:] for r in T.change_slots(spark.createDataFrame(slots, "tenant_id string, version long, policy string, limits string, provenance string"), spark.createDataFrame(changes, "seq long, tenant_id string, policy string, provenance string")).collect()}
    state = {t: T.Slot(v, p, w, li) for t, v, p, li, w in slots}
    for _, t, p, w in changes:
        T.upsert(state.setdefault(t, T.Slot()), p, w)
    assert got == {t: (s.version, s.policy, s.limits, s.provenance) for t, s in state.items()}


def test_large_slot_tables_resolve_alike(spark, monkeypatch):
    objects = spark.createDataFrame([(k, f"t{k % 5}" if k % 7 else None) for k in range(60)], "object_id long, tenant_id string")
    slots = spark.createDataFrame([("t1", 1, "strict"), ("t2", 1, None)], "tenant_id string, version long, policy string")
    want = sorted(map(tuple, T.resolve(objects, slots).collect()))
    monkeypatch.setattr(T, "BROADCAST_SLOTS", 0)
    assert sorted(map(tuple, T.resolve(objects, slots).collect())) == want and len(want) == 60


def test_canonical_snapshots_are_the_signed_texts(spark):
    import json

    rows = [('t"é', 3, {"audio_max_channels": 2}, {"actor": "x"}), ("u", 9, None, None)]
    df = spark.createDataFrame([(t, v, None if li is None else T.canonical_json({n: li.get(n) for n in T.LIMITS}), None if p is None else json.dumps(p, separators=(",", ":"))) for t, v, li, p in rows], "tenant_id string, version long, payload string, provenance string")
    got = [r[0] for r in df.select(T.canonical_snapshot("media", F.col("payload"), F.col("tenant_id"), F.col("version"), F.col("provenance"))).collect()]
    assert got == [T.media_payload(t, v, li, p) for t, v, li, p in rows]
