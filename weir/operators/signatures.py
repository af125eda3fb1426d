"""Byte-signature scans.

Few rules are predicates of the plan: whether a rule's pattern occurs where it may is said without offsets, because a
match that starts before n lies in the first n - 1 + length bytes, and one that ends after the last n bytes begin lies in
the last n - 1 + length. Many rules go through an automaton in Python (`scan_many`), built once in each worker.
Every rule is reported once for an object. Hits come in the order in which their first fitting matches end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.binary import lit_bytes


@dataclass(frozen=True)
class Rule:
    """location: Anywhere, FirstBytes (the match starts before `limit`) or LastBytes (it ends in the last `limit`)."""

    name: str
    pattern: bytes
    location: str = "Anywhere"
    limit: int | None = None


#: The standard antivirus test file, in two halves, so that this repository isn't taken for one.
_TEST_FILE = b"X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-" + b"ANTIVIRUS-TEST-FILE!$H+H*"

# Rules that every scan has, in the order in which their hits are reported.
BASELINE = (
    Rule("eicar_test_string", _TEST_FILE),
    Rule("pe_dos_header", b"MZ", "FirstBytes", 2),
    Rule("pe_signature", b"PE\0\0"),
    Rule("elf_magic", b"\x7fELF", "FirstBytes", 4),
    Rule("macho_magic_32_be", b"\xfe\xed\xfa\xce", "FirstBytes", 4),
    Rule("macho_magic_32_le", b"\xce\xfa\xed\xfe", "FirstBytes", 4),
    Rule("macho_magic_64_be", b"\xfe\xed\xfa\xcf", "FirstBytes", 4),
    Rule("macho_magic_64_le", b"\xcf\xfa\xed\xfe", "FirstBytes", 4),
    Rule("sh_shebang", b"#!/bin/sh", "FirstBytes", 16),
    Rule("bash_shebang", b"#!/bin/bash", "FirstBytes", 16),
    Rule("env_shebang", b"#!/usr/bin/env", "FirstBytes", 16),
    Rule("python_shebang", b"#!/usr/bin/python", "FirstBytes", 24),
    Rule("perl_shebang", b"#!/usr/bin/perl", "FirstBytes", 20),
    Rule("ruby_shebang", b"#!/usr/bin/ruby", "FirstBytes", 20),
    Rule("node_shebang", b"#!/usr/bin/node", "FirstBytes", 20),
    Rule("php_shebang", b"<?php", "FirstBytes", 8),
    Rule("java_class_magic", b"\xca\xfe\xba\xbe", "FirstBytes", 4),
    Rule("ole_cfb_magic", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "FirstBytes", 8),
    Rule("dex_magic", b"dex\n", "FirstBytes", 4),
    Rule("batch_echo_off", b"@echo off", "FirstBytes", 12),
    Rule("wasm_magic", b"\0asm", "FirstBytes", 4),
    Rule("rar_magic", b"Rar!\x1a\x07", "FirstBytes", 8),
    Rule("seven_zip_magic", b"7z\xbc\xaf\x27\x1c", "FirstBytes", 8),
)
# What no released object may begin with; the first that fits counts.
EXECUTABLE_MAGIC = (
    (b"MZ", "pe_in_output"),
    (b"\x7fELF", "elf_in_output"),
    (b"\xfe\xed\xfa\xce", "macho_in_output"),
    (b"\xce\xfa\xed\xfe", "macho_in_output"),
    (b"\xfe\xed\xfa\xcf", "macho_in_output"),
    (b"\xcf\xfa\xed\xfe", "macho_in_output"),
    (b"\xca\xfe\xba\xbe", "java_class_in_output"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole_cfb_in_output"),
    (b"dex\n", "dex_in_output"),
    (b"\0asm", "wasm_in_output"),
    (b"#!/", "script_shebang_in_output"),
    (b"<?php", "php_tag_in_output"),
    (b"@echo off", "batch_in_output"),
    (b"Rar!\x1a\x07", "rar_in_output"),
    (b"7z\xbc\xaf\x27\x1c", "seven_zip_in_output"),
)


def rule_set(extra: Iterable[Rule] = ()) -> list[Rule]:
    """The baseline, then the given rules; empty patterns don't count."""
    return [r for r in (*BASELINE, *extra) if r.pattern]


def occurs(data: Column, pattern: Column, length: Column, location: Column | str, limit: Column) -> Column:
    """Whether the pattern occurs at an allowed place."""
    total = F.length(data)
    reach = F.least(limit, F.lit(2**30)) - 1 + length
    location = F.lit(location) if isinstance(location, str) else location
    first = (limit > 0) & F.contains(F.substring(data, F.lit(1), reach.cast("int")), pattern)
    last_from = F.greatest(F.lit(1), total - reach + 1)
    last = (limit > 0) & F.contains(F.substring(data, last_from.cast("int"), total), pattern)
    return F.when(location == "FirstBytes", first).when(location == "LastBytes", last).otherwise(F.contains(data, pattern))


def _rule_matches(data: Column, r: Rule) -> Column:
    size = len(r.pattern)
    if r.location == "Anywhere":
        return F.contains(data, lit_bytes(r.pattern))
    if not r.limit or r.limit <= 0:
        return F.lit(False)
    if r.location == "FirstBytes":
        return data.startswith(lit_bytes(r.pattern)) if r.limit == 1 else F.contains(F.substring(data, 1, r.limit - 1 + size), lit_bytes(r.pattern))
    begin = F.greatest(F.lit(1), F.length(data) - (r.limit - 2 + size))
    return F.contains(F.substring(data, begin, F.length(data)), lit_bytes(r.pattern))


_MATCH = "array<struct<name:string,pattern:binary,location:string,limit:bigint>>"


def _in_order(data: Column, matched: Column) -> Column:
    """Names in order of the end of each rule's first fitting match; of equal ends the longer pattern, then the earlier rule, is first."""

    def end(text: Column, m: Column) -> Column:
        size = F.length(m["pattern"])
        start = F.when(m["location"] == "LastBytes", F.greatest(F.lit(1), F.length(text) - F.least(m["limit"], F.lit(2**30)) - size + 2)).otherwise(F.lit(1))
        return F.position(F.decode(m["pattern"], "ISO-8859-1"), text, start.cast("int")) + size

    def names(text: Column) -> Column:
        placed = F.transform(matched, lambda m, i: F.struct(end(text, m).alias("end"), (-F.length(m["pattern"])).alias("shorter"), i.alias("i"), m["name"].alias("name")))
        return F.transform(F.array_sort(placed), lambda x: x["name"])

    # in this character set a byte is a character, so that places can be found by built-in functions
    return F.transform(F.array(F.decode(data, "ISO-8859-1")), names)[0]


def hits(data: Column, rules: Sequence[Rule], user_rules: Column | None = None) -> Column:
    """The names of the rules that match, in order of the ends of their first matches; user_rules is a policy's array of rules.

    Places are looked for only where several rules match.
    """
    one = lambda r: F.struct(F.lit(r.name).alias("name"), lit_bytes(r.pattern).alias("pattern"), F.lit(r.location).alias("location"), F.lit(r.limit).cast("long").alias("limit"))
    which = lambda value: F.array_compact(F.array(*[F.when(_rule_matches(data, r), value(r)) for r in rules])) if rules else F.array()
    found, matched = which(lambda r: F.lit(r.name)).cast("array<string>"), which(one).cast(_MATCH)
    if user_rules is not None:
        fits = F.filter(user_rules, lambda r: (F.length(r["pattern"]) > 0) & occurs(data, r["pattern"], F.length(r["pattern"]), r["location"], F.coalesce(r["limit"], F.lit(0))))
        whole = F.transform(fits, lambda r: F.struct(r["name"].alias("name"), r["pattern"].alias("pattern"), r["location"].alias("location"), r["limit"].cast("long").alias("limit")))
        found = F.concat(found, F.coalesce(F.transform(fits, lambda r: r["name"]), F.array().cast("array<string>")))
        matched = F.concat(matched, F.coalesce(whole.cast(_MATCH), F.array().cast(_MATCH)))
    return F.when(F.size(found) > 1, _in_order(data, matched)).otherwise(found)


def scan_many(objects: DataFrame, rules: Sequence[Rule], id_col: str = "object_id", data_col: str = "payload") -> DataFrame:
    """id_col, rule, nth for every rule that matches: one pass over the bytes, however many rules there are.

    nth counts an object's rules from 0 in order of the ends of their first fitting matches, as `hits` has them.
    """
    wanted = [r for r in rules if r.pattern]
    rows = objects.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_pattern: dict[str, list[int]] = {}
        for k, r in enumerate(wanted):
            by_pattern.setdefault(r.pattern.decode("latin-1"), []).append(k)
        automaton = ahocorasick.Automaton()
        for p, ks in by_pattern.items():
            automaton.add_word(p, (len(p), ks))
        if by_pattern:
            automaton.make_automaton()
        for batch in batches:
            which, found, nth = [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None or not by_pattern:
                    continue
                seen: dict[int, None] = {}  # in order of the ends of first matches
                for end, (size, ks) in automaton.iter(data.decode("latin-1")):
                    for k in ks:
                        r = wanted[k]
                        fits = r.location == "Anywhere" or (end - size + 1 < (r.limit or 0) if r.location == "FirstBytes" else end + 1 > len(data) - (r.limit or 0) and (r.limit or 0) > 0)
                        if fits:
                            seen.setdefault(k)
                which += [i] * len(seen)
                found += [wanted[k].name for k in seen]
                nth += range(len(seen))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(found, pa.string()), pa.array(nth, pa.int32())], ["id", "rule", "nth"])

    return rows.mapInArrow(run, f"id {id_type}, rule string, nth int").withColumnRenamed("id", id_col)


def executable_magic(data: Column) -> Column:
    """The code of the executable or archive magic that the bytes begin with, else null."""
    out = None
    for magic, code in EXECUTABLE_MAGIC:
        fits = data.startswith(lit_bytes(magic))
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out
