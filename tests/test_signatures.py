import random

from pyspark.sql import functions as F

from weir.operators import signatures as S


def brute(data, rules):
    """Names of the rules by the end of the first fitting match, then the longer pattern, then the earlier rule."""
    out = []
    for k, r in enumerate(rules):
        for at in range(len(data) - len(r.pattern) + 1):
            if data[at : at + len(r.pattern)] == r.pattern:
                end = at + len(r.pattern)
                if r.location == "Anywhere" or (r.location == "FirstBytes" and at < (r.limit or 0)) or (r.location == "LastBytes" and end > len(data) - (r.limit or 0)):
                    out.append((end, -len(r.pattern), k, r.name))
                    break
    return [name for *_, name in sorted(out)]


def cases():
    rng = random.Random(1)
    rules = [S.Rule(f"{loc}{size}-{lim}-{k}", bytes(rng.choice(b"ab") for _ in range(size)), loc, lim) for k, (loc, size, lim) in enumerate((loc, size, lim) for loc in ("Anywhere", "FirstBytes", "LastBytes") for size in (1, 3, 5) for lim in (0, 1, 2, 4, 100))]
    data = [bytes(rng.choice(b"abc\xff\x80\xc3") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    return rules, data


def test_plan_and_automaton_against_brute_force(spark):
    rules, data = cases()
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)] + [(None, None)], "object_id long, payload binary")
    got = {r.object_id: r.h for r in rows.select("object_id", S.hits(F.col("payload"), rules).alias("h")).collect()}
    want = {k: brute(d, rules) for k, d in enumerate(data)}
    assert {k: v for k, v in got.items() if k is not None} == want
    seen = {}
    for r in S.scan_many(rows, rules).collect():
        seen.setdefault(r.object_id, []).append((r.nth, r.rule))
    assert {k: [name for _, name in sorted(v)] for k, v in seen.items()} == {k: v for k, v in want.items() if v}


def test_user_rules_of_a_policy(spark):
    rules, data = cases()
    user = [{"name": r.name, "pattern": bytearray(r.pattern), "location": r.location, "limit": r.limit} for r in rules] + [{"name": "empty", "pattern": bytearray(b""), "location": "Anywhere", "limit": None}]
    rows = spark.createDataFrame([(k, bytearray(d), user) for k, d in enumerate(data[:120])], "k long, d binary, u array<struct<name:string,pattern:binary,location:string,limit:long>>")
    for r in rows.select("k", S.hits(F.col("d"), [], F.col("u")).alias("h")).collect():
        assert r.h == brute(data[r.k], rules)


def test_baseline(spark):
    assert len(S.BASELINE) == 23 and len(S.BASELINE[0].pattern) == 68
    data = {b"MZ..": ["pe_dos_header"], b" MZ": ["pe_dos_header"], b"  MZ": [], b"x" * 90 + b"PE\0\0": ["pe_signature"], b"#!/bin/bash": ["bash_shebang"], b"\x7fELF": ["elf_magic"], S.BASELINE[0].pattern: ["eicar_test_string"], b"": []}
    rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "k int, d binary")
    got = [r.h for r in rows.select("k", S.hits(F.col("d"), S.rule_set()).alias("h")).orderBy("k").collect()]
    assert got == list(data.values())
    assert S.rule_set([S.Rule("none", b""), S.Rule("mine", b"q")])[-1].name == "mine"


def test_no_rules(spark):
    rows = spark.createDataFrame([(1, bytearray(b"MZ"))], "object_id int, payload binary")
    assert S.scan_many(rows, []).count() == 0 and rows.select(S.hits(F.col("payload"), []).alias("h")).first().h == []
