"""The registered queries over the driver's tables, each with the same question in SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType

from weir.functions import binary, names, sniff
from weir.operators import fidelity, gates, pipeline, rebuild, signatures, tenants
from weir.plans import policy
from weir.sources.derived import OBJECTS_SQL, derived_objects, format_objects, media_objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_objects(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([OBJECTS_SQL, *more]) + "\n" + body


# --- SQL pieces -----------------------------------------------------------------------------------------------------

EXT_SQL = "CASE WHEN regexp_matches(file_name, '^.+\\.[^.]*$') THEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) END"


def _case(column: str, values: dict[str, tuple[str, ...]], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {column} IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in values.items())
    return f"CASE {arms} ELSE {otherwise} END"


NAMED_SQL = f"""named AS (
  SELECT *, {EXT_SQL} AS ext FROM objects
), kinds AS (
  SELECT *, {_case('ext', names.KIND_OF_EXTENSION)} AS by_name, {_case('ext', names.MIME_OF_EXTENSION)} AS name_mime FROM named
)"""


def _sniff_sql(column: str) -> str:
    arms = []
    for mime, parts in sniff.SIGNATURES:
        tests = " AND ".join(f"substr({column}, {2 * at + 1}, {len(digits)}) = '{digits}'" for at, digits in parts)
        arms.append(f"WHEN {tests} THEN '{mime}'")
    return f"CASE {' '.join(arms)} END"


def _kind_of_mime_sql(column: str) -> str:
    return f"""CASE WHEN starts_with(lower({column}), 'image/gif') THEN 'gif' WHEN starts_with(lower({column}), 'image/svg') THEN 'other'
  WHEN starts_with(lower({column}), 'image/') THEN 'image' WHEN starts_with(lower({column}), 'video/') THEN 'video'
  WHEN starts_with(lower({column}), 'audio/') THEN 'audio' WHEN starts_with(lower({column}), 'application/') OR starts_with(lower({column}), 'text/') THEN 'other' END"""


def _normal_sql(column: str) -> str:
    plain = f"lower(trim(split_part({column}, ';', 1)))"
    return _case(plain, names.MIME_ALIASES, plain)


DETECTED_SQL = f"""{NAMED_SQL}, sniffed AS (
  SELECT *, {_sniff_sql('hx')} AS sniffed FROM kinds
), typed AS (
  SELECT *, {_kind_of_mime_sql('sniffed')} AS by_mime, {_normal_sql('name_mime')} AS n_name, {_normal_sql('sniffed')} AS n_sniffed, {_normal_sql('declared_mime')} AS n_declared,
         coalesce(len(string_split(file_name, '.')) >= 3 AND lower(string_split(file_name, '.')[-2]) IN ({', '.join(repr(x) for x in names.DANGEROUS)}), false) AS doubled,
         length(hx) >= 42 AND substr(hx, 1, 8) = '52494646' AND substr(hx, 17, 16) = '5745425056503858' AND substr(hx, 33, 2) = '0A' AND substr(hx, 42, 1) IN ('2', '3', '6', '7', 'A', 'B', 'E', 'F') AS animated
  FROM sniffed
), detected AS (
  SELECT *, CASE WHEN doubled THEN 'other' WHEN coalesce(by_mime, by_name, 'other') = 'image' AND animated THEN 'animated_image' ELSE coalesce(by_mime, by_name, 'other') END AS kind,
         coalesce(n_name <> n_sniffed, false) OR coalesce(n_declared <> n_sniffed, false) OR coalesce(n_declared <> n_name, false) OR coalesce(n_declared NOT LIKE '%/%' OR n_declared LIKE '%*%', false) AS disagree,
         coalesce(by_name <> by_mime AND NOT (by_name IN ('image', 'animated_image') AND by_mime IN ('image', 'animated_image')), false) AS apart
  FROM typed
)"""

BLOCKED_SQL = ", ".join(repr(x) for x in policy.BLOCKED_EXTENSIONS)


def _hit_sql(column: str, r: signatures.Rule) -> str:
    """A pattern at an even place of the hex digits, within the digits where it may be."""
    digits, size = r.pattern.hex().upper(), len(r.pattern)
    if r.location == "FirstBytes":
        column = f"substr({column}, 1, {2 * (r.limit - 1 + size)})"
    elif r.location == "LastBytes":
        column = f"right({column}, {2 * (r.limit - 1 + size)})"
    return f"regexp_matches({column}, '^(..)*?{digits}')"


def _end_sql(column: str, r: signatures.Rule) -> str:
    """The digits up to the end of a rule's first fitting match."""
    digits, size = r.pattern.hex().upper(), len(r.pattern)
    before, part = "0", column
    if r.location == "LastBytes":
        part = f"right({column}, {2 * (r.limit - 1 + size)})"
        before = f"length({column}) - length({part})"
    return f"{before} + length(regexp_extract({part}, '^(..)*?{digits}'))"


def _rules_sql(column: str, rules: list[signatures.Rule]) -> str:
    found = [f"CASE WHEN {_hit_sql(column, r)} THEN {{'at': {_end_sql(column, r)}, 'shorter': {-len(r.pattern)}, 'k': {k}, 'name': '{r.name}'}} END" for k, r in enumerate(rules)]
    return "list_transform(list_sort(list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL)), lambda x: x.name)"


RULES = signatures.rule_set()


# --- digests and bytes ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(encode(text)) AS sha256, strlen(text)::BIGINT AS n_bytes FROM documents")
def payload_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    data = F.encode("text", "UTF-8")
    return d.select("doc_id", binary.sha256(data).alias("sha256"), F.length(data).cast("long").alias("n_bytes"))


@query("SELECT sha256(encode(text)) AS sha256, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def digest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", binary.sha256(F.encode("text", "UTF-8")).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


_ENTROPY_SQL = """WITH bytes AS (
  SELECT doc_id, source, strlen(text) AS n, substr(hex(encode(text)), 2 * i + 1, 2) AS b FROM documents, range(0, strlen(text)) t(i)
), freq AS (SELECT doc_id, source, n, b, count(*) AS c FROM bytes GROUP BY ALL),
e AS (SELECT doc_id, any_value(source) AS source, -sum(c / n * log2(c / n)) AS entropy FROM freq GROUP BY doc_id)
"""


@query(_ENTROPY_SQL + "SELECT doc_id, round(entropy, 6) AS entropy FROM e")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(binary.byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


@query(_ENTROPY_SQL + "SELECT source, round(avg(entropy), 6) AS mean_entropy, round(max(entropy), 6) AS max_entropy FROM e GROUP BY source")
def entropy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", binary.byte_entropy(F.encode("text", "UTF-8")).alias("e"))
    return d.groupBy("source").agg(F.round(F.avg("e"), 6).alias("mean_entropy"), F.round(F.max("e"), 6).alias("max_entropy"))


@query(
    """WITH b AS (SELECT doc_id % 4 AS part, substr(hex(encode(text)), 2 * i + 1, 2) AS byte FROM documents, range(0, strlen(text)) t(i))
SELECT part, byte, count(*)::BIGINT AS n FROM b GROUP BY ALL"""
)
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("part"), F.encode("text", "UTF-8").alias("data"))
    return binary.byte_histogram(d, "part", "data")


@query("""SELECT p_partkey, ((p_size & 127) << 21) | ((p_size // 3) << 14) | ((p_partkey % 128) << 7) | (p_partkey % 100) AS size FROM part""")
def synchsafe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    p = table(spark, sf_dir, "part")
    data = F.concat(byte(F.col("p_size") % 128), byte(F.floor(F.col("p_size") / 3)), byte(F.col("p_partkey") % 128), byte(F.col("p_partkey") % 100))
    return p.select("p_partkey", data.alias("d")).select("p_partkey", binary.synchsafe(F.col("d"), 1).alias("size"))


_SECRET = b"weir-demo-key"


def _hmac_sql(message: str) -> str:
    key = _SECRET.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(f"""SELECT c_custkey, {_hmac_sql("c_name || '|' || c_custkey")} AS hmac FROM customer""")
def hmac_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat("c_name", F.lit("|"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", binary.hmac_sha256(_SECRET, F.encode(message, "UTF-8")).alias("hmac"))


# --- names, types, kinds --------------------------------------------------------------------------------------------


@query(with_objects("SELECT object_id, ext, by_name AS kind, name_mime AS mime FROM kinds", NAMED_SQL))
def kind_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived_objects(spark, sf_dir).withColumn("ext", names.extension(F.col("file_name")))
    return o.select("object_id", "ext", names.kind_of_extension(F.col("ext")).alias("kind"), names.mime_of_extension(F.col("ext")).alias("mime"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(f, '^.+\\.[^.]*$') THEN lower(regexp_extract(f, '\\.([^.]*)$', 1)) END AS ext
FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[^?#]*', 0), '([^/]*)$', 1) AS f FROM pages)""")
def url_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.regexp_extract(F.regexp_extract("url", "^[^?#]*", 0), "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", names.extension(file).alias("ext"))


@query(with_objects(f"SELECT object_id, {_kind_of_mime_sql('declared_mime')} AS kind, {_normal_sql('declared_mime')} AS normal FROM objects"))
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("declared_mime")
    return derived_objects(spark, sf_dir).select("object_id", names.kind_from_mime(d).alias("kind"), names.normal_mime(d).alias("normal"))


@query(with_objects("SELECT object_id, sniffed AS mime, by_mime AS kind FROM typed", DETECTED_SQL))
def sniff_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived_objects(spark, sf_dir).withColumn("mime", sniff.sniff_mime(F.col("payload")))
    return o.select("object_id", "mime", names.kind_from_mime(F.col("mime")).alias("kind"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.detected(derived_objects(spark, sf_dir))


@query(with_objects("SELECT object_id, doubled, kind FROM detected", DETECTED_SQL))
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("object_id", names.double_extension(F.col("file_name")).alias("doubled"), "kind")


@query(with_objects("SELECT object_id, n_name = n_sniffed AS name_fits, n_declared = n_sniffed AS declared_fits, disagree FROM detected", DETECTED_SQL))
def mime_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("object_id", (F.col("n_name") == F.col("n_sniffed")).alias("name_fits"), (F.col("n_declared") == F.col("n_sniffed")).alias("declared_fits"), "disagree")


@query(
    """SELECT p_partkey, CASE WHEN length(m) > 80 THEN substr(m, 1, 80) || '…' WHEN m = '' THEN 'empty panic message' ELSE m END AS summary
FROM (SELECT p_partkey, regexp_replace(repeat(p_name || 'é ', p_size % 5), '[^ -~]', '?', 'g') AS m FROM part)"""
)
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.repeat(F.concat("p_name", F.lit("é ")), F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", names.summary_of_failure(text).alias("summary"))


# --- signatures -----------------------------------------------------------------------------------------------------

PAGE_RULES = [
    signatures.Rule("doctype", b"<!DOCTYPE", "FirstBytes", 16),
    signatures.Rule("script", b"<script", "Anywhere"),
    signatures.Rule("closing", b"</html>", "LastBytes", 16),
    signatures.Rule("early_body", b"<body", "FirstBytes", 200),
    signatures.Rule("tail_div", b"</div>", "LastBytes", 40),
]


@query(f"SELECT page_id, array_to_string({_rules_sql('hex(encode(html))', PAGE_RULES)}, ',') AS rules FROM pages")
def sig_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    return p.select("page_id", F.array_join(signatures.hits(F.col("data"), PAGE_RULES), ",").alias("rules"))


@query(SQL["sig_locations"])
def sig_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("payload"))
    found = signatures.scan_many(p, PAGE_RULES, "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("nth", "rule"))).alias("found"))
    return p.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce(F.array_join("found.rule", ","), F.lit("")).alias("rules"))


@query(with_objects(f"SELECT object_id, array_to_string({_rules_sql('hx', RULES)}, ',') AS rules FROM objects"))
def sig_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_objects(spark, sf_dir).select("object_id", F.array_join(signatures.hits(F.col("payload"), RULES), ",").alias("rules"))


@query(with_objects(f"SELECT rule, count(*)::BIGINT AS objects FROM (SELECT unnest({_rules_sql('hx', RULES)}) AS rule FROM objects) GROUP BY rule"))
def sig_hits_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived_objects(spark, sf_dir).select(F.explode(signatures.hits(F.col("payload"), RULES)).alias("rule"))
    return o.groupBy("rule").agg(F.count("*").alias("objects"))


_MAGIC_SQL = "CASE " + " ".join(f"WHEN starts_with(hx, '{m.hex().upper()}') THEN '{c}'" for m, c in signatures.EXECUTABLE_MAGIC) + " END"


@query(with_objects(f"SELECT object_id, {_MAGIC_SQL} AS code FROM objects"))
def exec_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_objects(spark, sf_dir).select("object_id", signatures.executable_magic(F.col("payload")).alias("code"))


# --- gates ----------------------------------------------------------------------------------------------------------


def _policy(**changes: object) -> Column:
    """One policy as a literal struct."""
    p = policy.profile("standard", **changes)
    one = {k: v for k, v in p.items() if k != "signature_rules"}

    def lit(v: object) -> Column:
        if isinstance(v, dict):
            return F.struct(*[lit(x).alias(k) for k, x in v.items()])
        if isinstance(v, list):
            return F.array(*[F.lit(x) for x in v]).cast("array<string>")
        return F.lit(v)

    return lit(one)


@query(with_objects(f"""SELECT object_id, CASE WHEN octet_length(payload) > 4000 THEN 'FileTooLarge' WHEN ext IN ({BLOCKED_SQL}) THEN 'BlockedExtension' END AS error FROM named""", NAMED_SQL))
def size_and_extension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policy(max_input_size_bytes=4000)
    o = _detected(spark, sf_dir)
    return o.select("object_id", F.coalesce(gates.too_large(F.col("size"), p), gates.blocked_extension(F.col("ext"), p)).alias("error"))


@query(with_objects("""SELECT object_id, CASE WHEN apart THEN 'FileTypeMismatch' END AS kind_error, CASE WHEN disagree THEN 'FileTypeMismatch' END AS type_error,
       array_to_string(list_filter([CASE WHEN declared_mime IS NOT NULL AND sniffed IS NULL THEN 'declared_mime_unverified' END, CASE WHEN disagree THEN 'input_mime_mismatch' END], lambda x: x IS NOT NULL), ',') AS alerts,
       CASE WHEN by_name IS NULL OR by_mime IS NULL THEN 'Warning' WHEN apart THEN 'Blocked' ELSE 'Success' END AS status
FROM detected""", DETECTED_SQL))
def kind_and_type_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = _policy(), _detected(spark, sf_dir)
    a, b = F.col("by_name"), F.col("by_mime")
    codes = F.array_join(F.transform(gates.metadata_alerts(F.col("disagree"), F.col("sniffed"), F.col("declared_mime")), lambda x: x["code"]), ",")
    return o.select("object_id", gates.kind_mismatch(a, b, p).alias("kind_error"), gates.metadata_mismatch(F.col("disagree"), p).alias("type_error"), codes.alias("alerts"), gates.detect_status(a, b, p).alias("status"))


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value) or not re.match("[-0-9]", number):  # out of range, or NaN and Infinity, which aren't JSON
        raise ValueError(number)
    return value


def _json_whole(raw: bytes) -> bool:
    """One JSON value and nothing else: UTF-8, finite numbers, paired surrogates, fewer than 128 levels; repeated keys are allowed."""
    try:
        text = raw.decode()
        json.dumps(json.loads(text, parse_float=_finite, parse_int=_finite, parse_constant=_finite, object_pairs_hook=list), ensure_ascii=False).encode()
    except (ValueError, RecursionError):
        return False
    level = deepest = 0
    for mark in re.findall(r'"(?:[^"\\]|\\.)*"|([\[{\]}])', text):
        level += (mark in ("[", "{")) - (mark in ("]", "}"))
        deepest = max(deepest, level)
    return deepest < 128


@F.arrow_udf(BooleanType())
def _json_probe(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else _json_whole(d) for d in data.to_pylist()], pa.bool_())


@query(with_objects("""SELECT object_id, ext, CASE ext WHEN 'json' THEN coalesce(try(json_valid(nullif(decode(payload), ''))), false)
  WHEN 'pdf' THEN starts_with(hx, '255044462D') AND regexp_matches(hx, '^(..)*?2525454F46')
  WHEN 'xml' THEN coalesce(try(starts_with(ltrim(decode(payload), ' ' || chr(9) || chr(10) || chr(13)), '<')), false)
  WHEN 'zip' THEN substr(hx, 1, 8) IN ('504B0304', '504B0506', '504B0708') ELSE true END AS whole
FROM named""", NAMED_SQL))
def structured_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's answer: of all extensions, and of bytes that aren't UTF-8.

    JSON is judged strictly: try_parse_json of the gate takes single quotes and a second value, and refuses repeated keys.
    """
    is_json, data = F.coalesce(F.col("ext") == "json", F.lit(False)), F.col("payload")
    judged = F.coalesce(_json_probe(F.when(is_json, data)), F.lit(False))
    return _detected(spark, sf_dir).select("object_id", "ext", F.when(is_json, judged).otherwise(gates.structured(F.col("ext"), data)).alias("whole"))


_MIMES = ["image/png", "IMAGE/JPEG", "video/mp4", "audio/raw", "application/x-sh", "text/plain", "image/apng"]
_ALLOW = {"image": ["image/png", "image/jpeg", "image/webp"], "gif": ["image/gif"], "video": ["video/mp4", "video/raw"], "audio": ["audio/mpeg", "audio/aac", "audio/opus", "audio/flac", "audio/wav", "audio/raw"], "other": ["application/octet-stream"]}
_ALLOW_SQL = " ".join(f"WHEN '{k}' THEN lower(mime) IN ({', '.join(repr(x) for x in v)})" for k, v in (_ALLOW | {"animated_image": _ALLOW["image"]}).items())
_DENY_SQL = ", ".join(repr(x) for x in policy.DENIED_TYPES)


@query(with_objects(f"""SELECT object_id, array_to_string(list_filter([
  CASE WHEN {_MAGIC_SQL} IS NOT NULL THEN {_MAGIC_SQL} END,
  CASE WHEN lower(mime) IN ({_DENY_SQL}) THEN 'declared_output_mime_denied' END,
  CASE WHEN NOT (CASE kind {_ALLOW_SQL} END) THEN 'declared_output_mime_not_allowed' END,
  CASE WHEN declared_kind <> kind AND NOT (declared_kind IN ('image', 'animated_image') AND kind IN ('image', 'animated_image')) THEN 'declared_mime_kind_mismatch' END,
  CASE WHEN by_mime <> kind AND NOT (by_mime IN ('image', 'animated_image') AND kind IN ('image', 'animated_image')) THEN 'sniffed_output_kind_mismatch' END,
  CASE WHEN by_mime IS NULL THEN 'unknown_output_mime' END,
  CASE WHEN {_normal_sql('mime')} <> n_sniffed THEN 'output_mime_mismatch' END], lambda x: x IS NOT NULL), ',') AS alerts
FROM (SELECT *, {_kind_of_mime_sql('mime')} AS declared_kind FROM (SELECT *, ([{', '.join(repr(x) for x in _MIMES)}])[object_id % 7 + 1] AS mime FROM detected))""", DETECTED_SQL))
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policy(output_mime_denylist=policy.DENIED_TYPES)
    o = _detected(spark, sf_dir).withColumn("mime", F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("object_id") % 7 + 1).cast("int")))
    found = gates.output_alerts(F.col("kind"), F.col("mime"), F.col("payload"), F.col("sniffed"), p)
    return o.select("object_id", F.array_join(F.transform(found, lambda a: a["code"]), ",").alias("alerts"))


_DENIED_ROWS = [(f"application/x-type-{k}",) for k in range(2000)] + [("text/plain",)]


@query(with_objects("SELECT object_id FROM objects WHERE declared_mime = 'text/plain'"))
def deny_list_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    deny = spark.createDataFrame(_DENIED_ROWS, "mime string")  # a list of fixed size
    return derived_objects(spark, sf_dir).join(F.broadcast(deny), F.col("declared_mime") == F.col("mime"), "left_semi").select("object_id")


@query(with_objects("SELECT object_id FROM objects WHERE declared_mime IS NULL OR declared_mime <> 'text/plain'"))
def deny_list_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    deny = spark.createDataFrame(_DENIED_ROWS, "mime string")
    return derived_objects(spark, sf_dir).join(F.broadcast(deny), F.col("declared_mime") == F.col("mime"), "left_anti").select("object_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 50000 THEN 'OutputTooLarge' WHEN l_extendedprice / l_quantity > 1500 THEN 'OutputExpansionTooHigh' END AS error FROM lineitem""")
def expansion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policy(max_output_size_bytes=50000, max_output_expansion_ratio=1500.0)
    before, after = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(gates.output_too_large(after, p), gates.expands_too_much(before, after, p)).alias("error"))


_LEVELS = [("image", "image/png"), ("gif", "image/gif"), ("animated_image", "image/apng"), ("audio", "audio/wav"), ("video", "video/mp4"), ("other", "application/pdf"), ("image", "image/gif")]


@query("""WITH e AS (SELECT event_id, event_id % 7 AS k, (['semantic', 'structural', 'none'])[event_id % 3 + 1] AS reported, event_id % 2 = 0 AS strict FROM events),
a AS (SELECT *, CASE WHEN k IN (0, 1) THEN 2 WHEN k = 2 THEN 1 WHEN k IN (3, 4) THEN CASE reported WHEN 'semantic' THEN 2 WHEN 'structural' THEN 1 ELSE 0 END ELSE 0 END AS reached FROM e)
SELECT event_id, CASE reached WHEN 2 THEN 'Semantic' WHEN 1 THEN 'Structural' END AS achieved, reached >= CASE WHEN strict THEN 2 ELSE 1 END AS met FROM a""")
def reconstruction_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = (F.col("event_id") % 7 + 1).cast("int"), (F.col("event_id") % 3 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _LEVELS]), k)
    reported = F.element_at(F.array(F.lit("semantic"), F.lit("structural"), F.lit("none")), n)
    stages = F.array(gates.stage("AudioProbe", "Success", "x"), gates.stage("Rebuild", "Success", F.concat(F.lit("achieved_reconstruction="), reported)))
    e = table(spark, sf_dir, "events").select("event_id", gates.achieved_level(pick(0), pick(1), stages).alias("achieved"))
    required = F.when(F.col("event_id") % 2 == 0, "Semantic").otherwise("Structural")
    return e.select("event_id", "achieved", gates.level_met(required, F.col("achieved")).alias("met"))


# --- folds ----------------------------------------------------------------------------------------------------------

_CODES = [("info_note", 0), ("unknown_mime", 1), ("signature_match", 2)]


def _event_alerts() -> Column:
    """Zero to three alerts of an event, by its digits."""
    e = F.col("event_id")
    return gates.those(gates.ALERTS, *[F.when(F.floor(e / 5**k) % 5 == k, gates.alert(c, "m", s)) for k, (c, s) in enumerate(_CODES)])


_ALERTS_SQL = "WITH a AS (SELECT event_id, user_id, event_type, event_id % 5 = 0 AS i, (event_id // 5) % 5 = 1 AS w, (event_id // 25) % 5 = 2 AS b FROM events)\n"


@query(_ALERTS_SQL + """SELECT event_id, CASE WHEN b THEN 'blocked' WHEN w THEN 'suspicious' ELSE 'clean' END AS verdict, CASE WHEN b THEN 'Blocked' WHEN w THEN 'Warning' ELSE 'Success' END AS status,
 CASE WHEN b THEN 'signature_match' ELSE 'blocked' END AS reason, (i::INT + w::INT + b::INT)::BIGINT AS alerts FROM a""")
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _event_alerts().alias("a"))
    a = F.col("a")
    return e.select("event_id", gates.verdict(a).alias("verdict"), gates.status_of(a).alias("status"), gates.first_block_reason(a).alias("reason"), F.size("a").cast("long").alias("alerts"))


@query(_ALERTS_SQL + """SELECT event_id, CASE WHEN b OR w THEN 'suspicious' ELSE 'clean' END AS verdict, CASE WHEN b THEN 'm [dry-run: would block]' END AS message FROM a""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", gates.soften(_event_alerts()).alias("a"))
    softened = F.filter("a", lambda x: x["code"] == "signature_match")
    return e.select("event_id", gates.verdict(F.col("a")).alias("verdict"), F.when(F.size(softened) > 0, F.element_at(softened, 1)["message"]).alias("message"))


@query(_ALERTS_SQL + """SELECT event_type, CASE WHEN b THEN 'blocked' WHEN w THEN 'suspicious' ELSE 'clean' END AS verdict, count(*)::BIGINT AS events, sum(i::INT + w::INT + b::INT)::BIGINT AS alerts FROM a GROUP BY 1, 2""")
def verdicts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", _event_alerts().alias("a")).select("event_type", gates.verdict(F.col("a")).alias("verdict"), F.size("a").alias("n"))
    return e.groupBy("event_type", "verdict").agg(F.count("*").alias("events"), F.sum("n").cast("long").alias("alerts"))


# --- rebuild --------------------------------------------------------------------------------------------------------


def _le(value: Column, size: int) -> Column:
    """A number as little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _b(data: bytes) -> Column:
    return F.lit(bytearray(data))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("t")).withColumn("n", F.length("t"))


def _stripped(framed: DataFrame, walker: str) -> DataFrame:
    s = framed.select("doc_id", rebuild.STRIP[walker](F.col("f")).alias("s"))
    return s.select("doc_id", binary.sha256(F.col("s.output")).alias("sha256"), F.col("s.stripped").alias("stripped"), F.col("s.stripped_bytes").alias("stripped_bytes"))


_LE4 = "unhex(lpad(hex({0} % 256), 2, '0') || lpad(hex({0} // 256 % 256), 2, '0') || lpad(hex({0} // 65536 % 256), 2, '0') || lpad(hex({0} // 16777216), 2, '0'))"
_T = "WITH t AS (SELECT doc_id, encode(text) AS t, strlen(text) AS n FROM documents)\n"


@query(_T + "SELECT doc_id, sha256('\\xFF\\xFB\\x90\\x00'::BLOB || t) AS sha256, 2::BIGINT AS stripped, (10 + 128 + 128)::BIGINT AS stripped_bytes FROM t")
def strip_mp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail = b"ID3\x04\x00\x00\x00\x00\x01\x00" + b"x" * 128, b"TAG" + b"y" * 125
    framed = _texts(spark, sf_dir).withColumn("f", F.concat(_b(head), _b(b"\xff\xfb\x90\x00"), "t", _b(tail)))
    return _stripped(framed, "mp3")


@query(_T + f"""SELECT doc_id, sha256(encode('RIFF') || {_LE4.format('(28 + 8 + n + n % 2)')} || encode('WAVEfmt ') || unhex('10000000') || unhex('01000100401F0000401F000001000800') || encode('data') || {_LE4.format('n')} || t || CASE WHEN n % 2 = 1 THEN unhex('00') ELSE unhex('') END) AS sha256,
 1::BIGINT AS stripped, (8 + n)::BIGINT AS stripped_bytes FROM t""")
def strip_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = b"fmt \x10\x00\x00\x00" + bytes.fromhex("01000100401F0000401F000001000800")
    odd = F.when(F.col("n") % 2 == 1, _b(b"\0")).otherwise(_b(b""))
    framed = _texts(spark, sf_dir).withColumn("f", F.concat(_b(b"RIFF\0\0\0\0WAVE" + form + b"LIST"), _le(F.col("n"), 4), "t", odd, _b(b"data"), _le(F.col("n"), 4), "t", odd))
    return _stripped(framed, "wav")


@query(_T + """SELECT doc_id, CASE WHEN n > 0 THEN sha256(encode('fLaC') || unhex('80000022') || encode(repeat('s', 34)) || t) END AS sha256, CASE WHEN n > 0 THEN 2 ELSE 0 END::BIGINT AS stripped,
 CASE WHEN n > 0 THEN 4 + n + 4 + 3 ELSE 0 END::BIGINT AS stripped_bytes FROM t""")
def strip_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = _texts(spark, sf_dir).withColumn("f", F.concat(_b(b"fLaC\x00\x00\x00\x22" + b"s" * 34 + b"\x04"), _be(F.col("n"), 3), "t", _b(b"\x86\x00\x00\x03pic"), "t"))
    return _stripped(framed, "flac")

_BE4 = "unhex(lpad(hex({0}), 8, '0'))"


@query(_T + f"""SELECT doc_id, sha256(unhex('0000001066747970') || encode('isom0000') || unhex('000000186D6F6F76') || unhex('000000106D766864') || encode('headhead') || {_BE4.format('(8 + n)')} || encode('mdat') || t) AS sha256,
 2::BIGINT AS stripped, (8 + n + 12)::BIGINT AS stripped_bytes FROM t""")
def strip_mp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    moov = F.concat(_be(8 + 16 + 8 + n, 4), _b(b"moov\x00\x00\x00\x10mvhdheadhead"), _be(8 + n, 4), _b(b"udta"), "t")
    framed = _texts(spark, sf_dir).withColumn("f", F.concat(_b(b"\x00\x00\x00\x10ftypisom0000"), moov, _b(b"\x00\x00\x00\x0cfree...."), _be(8 + n, 4), _b(b"mdat"), "t"))
    return _stripped(framed, "mp4")

_VINT4 = "unhex('1' || lpad(hex({0}), 7, '0'))"


@query(_T + f"""SELECT doc_id, sha256(unhex('1A45DFA384') || encode('head') || unhex('18538067') || {_VINT4.format('(7 + 8 + n)')} || unhex('1549A96682') || encode('in') || unhex('1F43B675') || {_VINT4.format('n')} || t) AS sha256,
 1::BIGINT AS stripped, (8 + n)::BIGINT AS stripped_bytes FROM t""")
def strip_webm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    vint = lambda c: F.unhex(F.concat(F.lit("1"), F.lpad(F.hex(c.cast("long")), 7, "0")))
    inside = F.concat(_b(bytes.fromhex("1549A96682") + b"in"), _b(bytes.fromhex("1254C367")), vint(n), "t", _b(bytes.fromhex("1F43B675")), vint(n), "t")
    framed = _texts(spark, sf_dir).withColumn("f", F.concat(_b(bytes.fromhex("1A45DFA384") + b"head" + bytes.fromhex("18538067")), vint(7 + 16 + 2 * n), inside))
    return _stripped(framed, "webm")


@F.arrow_udf(BinaryType())
def _ogg_paged(data: pa.Array) -> pa.Array:
    """Each packet as pages of up to 255 segments of up to 255 bytes; the last segment is shorter than 255, so it may be empty."""
    out = []
    for d in data:
        raw, pages = d.as_py(), []
        for at in range(0, len(raw or b"") + 1, 255 * 255):
            body = raw[at : at + 255 * 255] if raw else b""
            lacing = (b"\xff" * (len(body) // 255) + bytes([len(body) % 255]))[:255]
            pages.append(b"OggS\x00" + (b"\x01" if at else b"\x00") + b"\0" * 20 + bytes([len(lacing)]) + lacing + body)
        out.append(None if raw is None else b"".join(pages))
    return pa.array(out, pa.binary())


@query()
def strip_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text as one audio packet over as many pages as it needs. Pages are framed in Python, so SQL has no part in it."""
    from weir.operators.containers.audio import ogg_page

    head = b"OggS\x00\x02" + b"\0" * 16
    first, tags = ogg_page(head, b"OpusHead" + b"x" * 11), ogg_page(b"OggS\x00\x00" + b"\0" * 16, b"OpusTags" + b"c" * 200)
    return _stripped(_texts(spark, sf_dir).withColumn("f", F.concat(_b(first + tags), _ogg_paged(F.col("t")))), "ogg")


# --- the whole pipeline ---------------------------------------------------------------------------------------------


@query(with_objects(f"""SELECT object_id, kind, CASE WHEN ext IN ({BLOCKED_SQL}) THEN 'BlockedExtension' END AS error_kind, len(hits)::BIGINT AS hit_count,
 CASE WHEN ext IN ({BLOCKED_SQL}) THEN NULL WHEN len(hits) > 0 THEN 'blocked' WHEN by_name IS NULL OR by_mime IS NULL THEN 'suspicious' ELSE 'clean' END AS verdict
FROM (SELECT *, {_rules_sql('hx', RULES + [signatures.Rule('word_the', b' the ', 'Anywhere'), signatures.Rule('ends_dot', b'.', 'LastBytes', 1)])} AS hits FROM detected)""", DETECTED_SQL))
def pipeline_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, signature hits and verdict of every object, without rebuilding."""
    p = _policy()
    rules = RULES + [signatures.Rule("word_the", b" the ", "Anywhere"), signatures.Rule("ends_dot", b".", "LastBytes", 1)]
    o = _detected(spark, sf_dir).withColumn("hits", signatures.hits(F.col("payload"), rules)).withColumn("error_kind", gates.blocked_extension(F.col("ext"), p))
    alerts = F.concat(gates.signature_alerts(F.col("hits")), gates.unknown_alerts(F.col("by_name"), F.col("by_mime"), p))
    return o.select("object_id", "kind", "error_kind", F.size("hits").cast("long").alias("hit_count"), F.when(F.col("error_kind").isNull(), gates.verdict(alerts)).alias("verdict"))


_FULL_SQL = f"""early AS (
  SELECT *, CASE WHEN ext IN ({BLOCKED_SQL}) THEN 'BlockedExtension' END AS early_error, {_rules_sql('hx', RULES)} AS hits FROM detected
), decided AS (
  SELECT *, coalesce(early_error, CASE WHEN len(hits) = 0 AND (apart OR disagree) THEN 'FileTypeMismatch' END) AS error, early_error IS NULL AND len(hits) > 0 AS stopped FROM early
)"""


@query(with_objects("""SELECT object_id, error AS error_kind, CASE WHEN error IS NULL THEN 'blocked' END AS verdict, false AS released,
 CASE WHEN error IS NULL THEN CASE WHEN stopped THEN 'pre_scan_blocked' ELSE kind END END AS parser_used FROM decided""", DETECTED_SQL, _FULL_SQL))
def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline under the standard profile: none of these objects is whole media, so none may be released."""
    out = pipeline.defend(derived_objects(spark, sf_dir), policy.policy_table(spark))
    return out.select("object_id", "error_kind", "verdict", "released", "parser_used")


@query(with_objects("""SELECT object_id, tenant_id, source, 'blocked' AS verdict FROM decided WHERE error IS NULL AND NOT stopped""", DETECTED_SQL, _FULL_SQL))
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.defend(derived_objects(spark, sf_dir), policy.policy_table(spark))
    return pipeline.audit_events(out).select("object_id", "tenant_id", "source", "verdict")


@query(with_objects("""SELECT object_id, array_to_string(list_transform(hits, lambda x: 'signature_match'), ',') AS alerts, sha256(payload) AS sha256, coalesce(sniffed, 'application/octet-stream') AS mime FROM decided WHERE stopped""", DETECTED_SQL, _FULL_SQL))
def pre_scan_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.defend(derived_objects(spark, sf_dir), policy.policy_table(spark)).filter("parser_used = 'pre_scan_blocked'")
    return out.select("object_id", F.array_join(F.transform("alerts", lambda a: a["code"]), ",").alias("alerts"), "sha256", "mime")


_POLICY_IDS = ["standard", "nosuch", None, "strict", "standard"]


@query(with_objects("""SELECT object_id, CASE WHEN object_id % 5 = 1 THEN 'UnknownPolicy' WHEN early_error IS NOT NULL THEN early_error WHEN object_id % 5 = 3 THEN 'other' WHEN error IS NULL THEN 'none' ELSE error END AS error FROM decided""", DETECTED_SQL, _FULL_SQL))
def unknown_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object has a row: one whose policy isn't in the table is an error, and a policy that stands there twice counts once."""
    wanted = F.element_at(F.array(*[F.lit(x).cast("string") for x in _POLICY_IDS]), (F.col("object_id") % 5 + 1).cast("int"))
    policies = policy.policy_table(spark)
    out = pipeline.defend(derived_objects(spark, sf_dir).withColumn("policy_id", wanted), policies.unionByName(policies))
    strict = (F.col("object_id") % 5 == 3) & ~F.coalesce(F.col("error_kind") == "BlockedExtension", F.lit(False))
    return out.select("object_id", F.when(strict, "other").otherwise(F.coalesce("error_kind", F.lit("none"))).alias("error"))


@F.arrow_udf(StringType())
def _content_digest(data: pa.Array, mime: pa.Array) -> pa.Array:
    """Of stills and animations the digest of the decoded pixels (RGBA), else that of the bytes."""
    from weir.operators.codecs import gif, png

    out = []
    for d, m in zip(data.to_pylist(), mime.to_pylist()):
        content = d
        if d and m == "image/png":
            content = png.decode(d).tobytes()
        elif d and m == "image/gif":
            content = b"".join(f.rgba.tobytes() for f in gif.frames(d, 100, 1 << 24))
        out.append(None if not d else hashlib.sha256(content).hexdigest())
    return pa.array(out, pa.string())


@query(f"""WITH o AS (SELECT doc_id, doc_id % 4 AS k, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) + 1 AS m FROM documents)
SELECT doc_id AS object_id, CASE WHEN k = 3 THEN 'FileTypeMismatch' END AS error_kind, CASE WHEN k < 3 THEN 'clean' END AS verdict, k < 3 AS released,
 CASE k WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' END AS mime,
 CASE k WHEN 0 THEN sha256(encode('RIFF') || {_LE4.format('(36 + m + m % 2)')} || encode('WAVEfmt ') || unhex('10000000') || unhex('01000100401F0000401F000001000800') || encode('data') || {_LE4.format('m')} || unhex('80') || t || CASE WHEN m % 2 = 1 THEN unhex('00') ELSE unhex('') END)
   WHEN 1 THEN sha256(unhex(regexp_replace('80' || hex(t), '(..)', '\\1\\1\\1FF', 'g')))
   WHEN 2 THEN sha256(unhex('000000FF')) END AS content_sha256,
 CASE k WHEN 0 THEN 'AudioProbe,Rebuild' WHEN 1 THEN 'ImageProbe' WHEN 2 THEN 'GifProbe' END AS handler_stages,
 CASE k WHEN 0 THEN 'audio_metadata_stripped' WHEN 1 THEN 'image_metadata_stripped' WHEN 2 THEN 'gif_metadata_stripped' END AS alerts
FROM o""")
def released_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole media files through the pipeline: released without metadata, with the same samples and pixels."""
    out = pipeline.defend(media_objects(spark, sf_dir), policy.policy_table(spark))
    handler = F.slice(F.transform("stages", lambda s: s["stage"]), 4, F.when(F.col("mime") == "audio/wav", 2).otherwise(1))
    return out.select(
        "object_id", "error_kind", "verdict", "released", "mime", _content_digest("output", "mime").alias("content_sha256"),
        F.array_join(handler, ",").alias("handler_stages"), F.array_join(F.transform("alerts", lambda a: a["code"]), ",").alias("alerts"),
    )


@F.arrow_udf(StringType())
def _levels_digest(data: pa.Array, mime: pa.Array, step: pa.Array) -> pa.Array:
    """The digest of the samples (of FLAC of eight bits), or of every step-th pixel's red in both directions."""
    import numpy as np

    from weir.operators.codecs import flac, png

    out = []
    for d, m, n in zip(data.to_pylist(), mime.to_pylist(), step.to_pylist()):
        if not d:
            out.append(None)
            continue
        levels = b"".join(x.astype(np.int8).tobytes() for x in flac.frames(d)) if m == "audio/flac" else png.decode(d)[::n, ::n, 0].tobytes()
        out.append(hashlib.sha256(levels).hexdigest())
    return pa.array(out, pa.string())


@query("""WITH o AS (SELECT doc_id, doc_id % 3 AS k, unhex('80') || encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) + 1 AS m FROM documents),
c AS (SELECT *, least(m, 8000) AS w FROM o)
SELECT doc_id AS object_id, 'clean' AS verdict, true AS released, CASE k WHEN 0 THEN 'audio/flac' ELSE 'image/png' END AS mime,
 sha256(CASE k WHEN 2 THEN t || unhex(repeat('00', ((w - m % w) % w)::INTEGER)) ELSE t END) AS levels_sha256,
 CASE k WHEN 0 THEN 'audio_metadata_stripped' ELSE 'image_metadata_stripped' END AS alerts,
 CASE k WHEN 0 THEN 'independent_read: all audio read, ' || m || ' sample frames' WHEN 1 THEN 'independent_read: image decoded completely, ' || m || 'x1'
   ELSE 'independent_read: image decoded completely, ' || (8 * w - 7) || 'x' || (8 * ((m + w - 1) // w) - 7) END AS read
FROM c""")
def released_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole FLAC, TIFF and JPEG files through the pipeline: the same samples and pixels come out, read to the end."""
    widest = policy.profile("standard", image={**policy.STANDARD["image"], "max_pixels": 1 << 31})
    out = pipeline.defend(format_objects(spark, sf_dir), policy.policy_table(spark, {"standard": widest}))
    step = F.when(F.pmod("object_id", F.lit(3)) == 2, 8).otherwise(1)
    return out.select(
        "object_id", "verdict", "released", "mime", _levels_digest("output", "mime", step).alias("levels_sha256"),
        F.array_join(F.transform("alerts", lambda a: a["code"]), ",").alias("alerts"),
        F.get(F.filter(F.transform("stages", lambda s: s["detail"]), lambda d: d.startswith("independent_read")), F.lit(0)).alias("read"),
    )


# --- tenants --------------------------------------------------------------------------------------------------------


@query(with_objects("SELECT object_id, CASE tenant_id WHEN 't1' THEN 'strict' WHEN 't3' THEN 'paranoid' ELSE 'standard' END AS policy_id FROM objects"))
def tenant_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([("t1", 3, "strict"), ("t3", 1, "paranoid"), ("t5", 9, None)], "tenant_id string, version long, policy string")
    return tenants.resolve(derived_objects(spark, sf_dir), slots).select("object_id", "policy_id")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 10).cast("long").alias("version"))


@query("""WITH v AS (SELECT event_id, user_id, round(value * 10)::BIGINT AS version FROM events),
w AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v)
SELECT event_id, CASE WHEN top IS NULL OR version > top THEN 'upsert_applied' ELSE 'upsert_ignored_stale' END AS outcome FROM w""")
def slot_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenants.upsert_only(_versions(spark, sf_dir), "user_id", "event_id", "version").select("event_id", "outcome")


def _policy_events(spark: SparkSession, sf_dir: str, removes: bool) -> DataFrame:
    payload = F.when(F.lit(not removes) | (F.col("event_id") % 5 != 0), F.concat(F.lit("p"), F.col("event_id").cast("string")))
    kind = F.when(F.lit(removes) & (F.col("event_id") % 3 == 0), "media").otherwise("policy")
    v = _versions(spark, sf_dir)
    return v.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("tenant_id"), "version", kind.alias("kind"), payload.alias("payload"), F.lit(None).cast("string").alias("provenance"))


@query("""WITH v AS (SELECT event_id, user_id, round(value * 10)::BIGINT AS version FROM events)
SELECT user_id::VARCHAR AS tenant_id, max(version) AS version, 'p' || arg_min(event_id, struct_pack(a := -version, b := event_id)) AS policy FROM v GROUP BY 1""")
def slot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenants.latest(tenants.fold(_policy_events(spark, sf_dir, False))).select("tenant_id", "version", "policy")


@query("""WITH v AS (SELECT event_id, user_id, round(value * 10)::BIGINT AS version FROM events),
w AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v)
SELECT count(*) FILTER (top IS NULL OR version > top)::BIGINT AS upsert_applied, count(*) FILTER (version <= top)::BIGINT AS upsert_ignored_stale, 0::BIGINT AS remove_applied,
 0::BIGINT AS remove_ignored_stale, 0::BIGINT AS remove_already_removed, 0::BIGINT AS rejected_invalid_signature FROM w""")
def slot_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenants.import_report(tenants.fold(_policy_events(spark, sf_dir, False)))


@query("""WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, round(value * 10)::BIGINT AS v, event_id % 3 = 0 AS media, event_id % 5 = 0 AS gone FROM events
), f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS version, false AS policy, false AS limits, NULL::VARCHAR AS outcome FROM events
  UNION ALL
  SELECT user_id, k + 1, CASE WHEN o IN ('upsert_applied', 'remove_applied') THEN v ELSE version END,
         CASE WHEN o = 'upsert_applied' AND NOT media THEN true WHEN o = 'remove_applied' AND NOT media THEN false ELSE policy END,
         CASE WHEN o = 'upsert_applied' THEN media WHEN o = 'remove_applied' THEN false ELSE limits END, o
  FROM (
    SELECT f.*, e.v, e.media, CASE
        WHEN NOT e.gone THEN CASE WHEN f.version >= e.v THEN 'upsert_ignored_stale' ELSE 'upsert_applied' END
        WHEN f.version > e.v THEN 'remove_ignored_stale'
        WHEN f.version = e.v AND NOT (CASE WHEN e.media THEN f.limits ELSE f.policy OR f.limits END) THEN 'remove_already_removed'
        ELSE 'remove_applied' END AS o
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1
  ) step
)
SELECT count(*) FILTER (outcome = 'upsert_applied')::BIGINT AS upsert_applied, count(*) FILTER (outcome = 'upsert_ignored_stale')::BIGINT AS upsert_ignored_stale,
 count(*) FILTER (outcome = 'remove_applied')::BIGINT AS remove_applied, count(*) FILTER (outcome = 'remove_ignored_stale')::BIGINT AS remove_ignored_stale,
 count(*) FILTER (outcome = 'remove_already_removed')::BIGINT AS remove_already_removed, 0::BIGINT AS rejected_invalid_signature FROM f""")
def slot_mixed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and removals of policies and media limits: only a fold in order gives these counts."""
    return tenants.import_report(tenants.fold(_policy_events(spark, sf_dir, True)))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'current' ELSE CASE WHEN now > dep + 10000 THEN 'expired' ELSE 'in_grace' END END AS state
FROM (SELECT event_id, event_id * 7 % 40000 AS now, CASE event_id % 3 WHEN 1 THEN 1000 WHEN 2 THEN 20000 END AS dep FROM events)""")
def key_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    dep = F.when(e % 3 == 1, F.lit(1000).cast("long")).when(e % 3 == 2, F.lit(20000).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", tenants.key_state(e * 7 % 40000, dep, F.lit(10000).cast("long")).alias("state"))


RING = tenants.KeyRing({"k0": tenants.Key(_SECRET), "k1": tenants.Key(_SECRET, 1000), "k2": tenants.Key(b"other")}, 10000)


@query("""SELECT key_id, count(*)::BIGINT AS seen, count(*) FILTER (state IN ('v', 'g'))::BIGINT AS verified, count(*) FILTER (state = 'g')::BIGINT AS verified_in_grace, count(*) FILTER (state = 'u')::BIGINT AS rejected_unknown_key,
 count(*) FILTER (state = 'e')::BIGINT AS rejected_expired, count(*) FILTER (state = 'i')::BIGINT AS rejected_invalid_signature
FROM (SELECT 'k' || (c_custkey % 4) AS key_id, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'i' ELSE 'v' END
  WHEN 1 THEN CASE WHEN c_custkey * 11 > 11000 THEN 'e' WHEN c_custkey % 5 = 0 THEN 'i' ELSE 'g' END WHEN 2 THEN 'i' ELSE 'u' END AS state FROM customer) GROUP BY key_id""")
def key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("k"), (F.col("c_custkey") % 4).cast("string")).alias("key_id"), F.concat("c_name", F.lit("|"), F.col("c_custkey").cast("string")).alias("payload"))
    signed = F.when(F.col("c_custkey") % 5 == 0, "tampered").otherwise(binary.hmac_sha256(_SECRET, F.encode("payload", "UTF-8")))
    outcome = tenants.verification(F.col("payload"), F.col("key_id"), F.col("signed"), RING, F.col("c_custkey") * 11)
    return tenants.key_usage(c.withColumn("signed", signed).select("key_id", outcome.alias("outcome")))


_FALLBACK = {"video_max_duration_secs": 3600, "video_max_bitrate_kbps": 20000, "audio_max_duration_secs": 3600, "audio_max_bitrate_kbps": 1536, "audio_max_channels": 6}


@query("""WITH p AS (SELECT 't' || s_suppkey AS tenant_id, s_suppkey * 10 AS a, s_suppkey * 20 AS b FROM supplier WHERE s_suppkey % 2 = 0),
m AS (SELECT 't' || s_suppkey AS tenant_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey + 1 END AS a FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(p.tenant_id, m.tenant_id) AS tenant_id, coalesce(m.a, CASE WHEN p.tenant_id IS NULL THEN 3600 ELSE p.a END)::BIGINT AS video_max_duration_secs,
 (CASE WHEN p.tenant_id IS NULL THEN 20000 ELSE p.b END)::BIGINT AS video_max_bitrate_kbps FROM p FULL JOIN m ON p.tenant_id = m.tenant_id""")
def policy_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    null = F.lit(None).cast("long")
    cols = lambda a, b: [F.concat(F.lit("t"), k.cast("string")).alias("tenant_id"), a.alias("video_max_duration_secs"), b.alias("video_max_bitrate_kbps"), *[null.alias(c) for c in tenants.LIMITS[2:]]]
    base = s.filter(k % 2 == 0).select(*cols(k * 10, k * 20))
    limits = s.filter(k % 3 == 0).select(*cols(F.when(k % 5 != 0, k + 1), null))
    return tenants.override(base, limits, _FALLBACK).select("tenant_id", "video_max_duration_secs", "video_max_bitrate_kbps")


@query("""SELECT c_custkey, sha256(encode('{"tenant_id":"' || c_name || '","version":' || c_custkey || ',"limits":{"video_max_duration_secs":' || c_nationkey || ',"video_max_bitrate_kbps":null,"audio_max_duration_secs":null,"audio_max_bitrate_kbps":null,"audio_max_channels":2},"provenance":null}')) AS sha256 FROM customer""")
def snapshot_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.struct(F.col("c_nationkey").alias("video_max_duration_secs"), *[F.lit(None).cast("long").alias(c) for c in tenants.LIMITS[1:4]], F.lit(2).alias("audio_max_channels"))
    whole = F.to_json(F.struct(F.col("c_name").alias("tenant_id"), F.col("c_custkey").alias("version"), limits.alias("limits"), F.lit(None).cast("string").alias("provenance")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "customer").select("c_custkey", binary.sha256(F.encode(whole, "UTF-8")).alias("sha256"))


@query("""WITH c AS (SELECT 't' || (event_id % 400) AS tenant_id, count(*) AS n, max_by(event_id, event_id) AS last FROM events WHERE event_id % 400 < 150 GROUP BY 1),
s AS (SELECT 't' || (s_suppkey % 400) AS tenant_id, s_suppkey AS version FROM supplier)
SELECT coalesce(c.tenant_id, s.tenant_id) AS tenant_id, coalesce(s.version, 0) + coalesce(c.n, 0) AS version,
 CASE WHEN c.tenant_id IS NULL THEN 'base' WHEN last % 3 <> 0 THEN 'p' || last END AS policy, CASE WHEN c.tenant_id IS NULL THEN 'limits' END AS limits,
 CASE WHEN c.tenant_id IS NULL THEN 'old' WHEN last % 3 <> 0 THEN 'new' END AS provenance FROM c FULL JOIN s ON c.tenant_id = s.tenant_id""")
def slot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unconditional upserts and removals over a table of slots."""
    s, e = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "events").filter("event_id % 400 < 150")
    name = lambda c: F.concat(F.lit("t"), (F.col(c) % 400).cast("string")).alias("tenant_id")
    slots = s.select(name("s_suppkey"), F.col("s_suppkey").alias("version"), F.lit("base").alias("policy"), F.lit("limits").alias("limits"), F.lit("old").alias("provenance"))
    changes = e.select(F.col("event_id").alias("seq"), name("event_id"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("policy"), F.lit("new").alias("provenance"))
    return tenants.change_slots(slots, changes)


def _signed(part: str) -> str:
    """SQL of a snapshot's signed text."""
    return f"""'{{"tenant_id":"t' || c_nationkey || '","version":' || version || ',"{part}":{{"v":' || c_custkey || '}},"provenance":null}}'"""


_IMPORT_FORMS = [("policy", "plain"), ("policy", "sha"), ("policy", "hmac"), ("policy", "ring"), ("media", "plain"), ("media", "sha"), ("media", "hmac"), ("media", "ring")]


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey * 7 % 101 AS version FROM customer),
forms AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _IMPORT_FORMS)}) v(kind, form)),
s AS (SELECT *, CASE WHEN kind = 'policy' THEN {_signed('policy')} ELSE {_signed('limits')} END AS text FROM c, forms),
a AS (SELECT *, CASE form WHEN 'plain' THEN true WHEN 'ring' THEN c_custkey % 7 <> 0 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND c_custkey * 11 <= 11000) ELSE c_custkey % 7 <> 0 END AS good,
  CASE form WHEN 'sha' THEN sha256(encode(text)) WHEN 'plain' THEN NULL ELSE {_hmac_sql('text')} END AS signature FROM s),
w AS (SELECT *, max(CASE WHEN good THEN version END) OVER (PARTITION BY kind, form, c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
SELECT kind, form, c_custkey AS seq, CASE WHEN NOT good THEN 'rejected_invalid_signature' WHEN top >= version THEN 'upsert_ignored_stale' ELSE 'upsert_applied' END AS outcome, signature FROM w""")
def snapshot_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight imports. Each snapshot is signed by its own fields; one in seven is changed afterwards."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tenant_id"), (F.col("c_custkey") * 7 % 101).alias("version"))
    c = c.withColumn("payload", F.concat(F.lit('{"v":'), F.col("seq").cast("string"), F.lit("}"))).withColumn("provenance", F.lit(None).cast("string"))
    c = c.withColumn("key_id", F.concat(F.lit("k"), (F.col("seq") % 4).cast("string")))
    out = None
    for kind, form in _IMPORT_FORMS:
        text = tenants.canonical_snapshot(kind, F.col("payload"), F.col("tenant_id"), F.col("version"), F.col("provenance"))
        signature = F.lit(None).cast("string") if form == "plain" else F.sha2(text.cast("binary"), 256) if form == "sha" else binary.hmac_sha256(_SECRET, text.cast("binary"))
        rows = c.withColumn("signature", signature).withColumn("sha256", F.col("signature")).withColumn("hmac_sha256", F.col("signature"))
        if form != "plain":
            rows = rows.withColumn("payload", F.when(F.col("seq") % 7 == 0, '{"v":-1}').otherwise(F.col("payload")))
        done = tenants.imported(rows, kind, form, _SECRET, RING, F.col("seq") * 11).select("seq", "outcome")
        one = done.join(c.select(F.col("seq").alias("c_seq"), signature.alias("signature")), F.col("seq") == F.col("c_seq"))
        one = one.select(F.lit(kind).alias("kind"), F.lit(form).alias("form"), "seq", "outcome", "signature")
        out = one if out is None else out.unionByName(one)
    return out


_SOUNDS = ["audio/ogg", "audio/opus", "audio/x-wav", "audio/wav", "audio/mpeg", "audio/aac", "audio/flac", "audio/x-flac", "video/mp4", "audio/amr"]


@query("""SELECT event_id, k < 7 AS is_audio, CASE WHEN k IN (0, 1) THEN 'audio/opus' WHEN k IN (2, 3) THEN 'audio/wav' WHEN k = 4 THEN 'audio/mpeg' WHEN k = 5 THEN 'audio/aac' WHEN k = 6 THEN 'audio/flac' ELSE 'audio/unknown' END AS canonical
FROM (SELECT event_id, event_id % 10 AS k FROM events)""")
def audio_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(*[F.lit(x) for x in _SOUNDS]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", names.is_audio_type(mime).alias("is_audio"), names.canonical_audio(mime).alias("canonical"))


@query("""SELECT n_regionkey, count(*)::BIGINT AS files, sha256(encode(string_agg(sha256(encode(n_name)) || '  ' || lower(n_name) || '/x' || n_nationkey || chr(10), '' ORDER BY lower(n_name) || '/x' || n_nationkey))) AS manifest_sha256 FROM nation GROUP BY 1""")
def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.sources.sinks import ordinal_manifest

    path = F.concat(F.lower("n_name"), F.lit("/x"), F.col("n_nationkey").cast("string"))
    return ordinal_manifest(table(spark, sf_dir, "nation").select("n_regionkey", path.alias("path"), F.sha2(F.encode("n_name", "UTF-8"), 256).alias("sha256")), ("n_regionkey",))


# --- measures -------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity = 0 AND l_tax = 0 THEN 0 ELSE 2 * abs(l_quantity - l_tax) / (l_quantity + l_tax) END, 9) AS error FROM lineitem""")
def duration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fidelity.duration_error(F.col("l_quantity"), F.col("l_tax")), 9).alias("error"))


@query("""WITH m AS (SELECT user_id AS case_id, 0 AS channel, value AS x, value * 0.5 + event_id % 7 AS y FROM events),
c AS (SELECT case_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM m WINDOW w AS (PARTITION BY case_id)),
s AS (SELECT case_id, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM c GROUP BY 1)
SELECT case_id, CASE WHEN n > 2 THEN round(10 * log10(greatest(xy * xy / xx, 1e-30) / greatest(yy - xy * xy / xx, 1e-30)), 3) END AS si_sdr_db FROM s""")
def si_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.lit(0).alias("channel"), F.col("event_id").alias("pos"), F.col("value").alias("reference"), (F.col("value") * 0.5 + F.col("event_id") % 7).alias("estimate"))
    return fidelity.si_sdr(e).select("case_id", F.round("si_sdr_db", 3).alias("si_sdr_db"))


@query("SELECT event_type AS case_id, round(avg(value), 6) AS mean_ssim, avg(value) >= 50 AS passed FROM events GROUP BY 1")
def mean_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("case_id"), F.col("value").alias("ssim"))
    return fidelity.mean_ssim(e, least=50).select("case_id", F.round("mean_ssim", 6).alias("mean_ssim"), "passed")


@query("""SELECT n_name AS case_id, 'missing' AS problem FROM nation WHERE n_nationkey % 4 = 3
UNION ALL SELECT n_name, 'repeated' FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT n_name, 'failed' FROM nation WHERE n_nationkey % 4 = 2""")
def evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 4
    copies = F.explode(F.array_repeat(F.lit(1), F.when(k == 3, 0).when(k == 1, 2).otherwise(1)))
    evidence = n.select(F.col("n_name").alias("case_id"), (k != 2).alias("passed"), copies.alias("copy")).drop("copy")
    return fidelity.evidence_problems(evidence, n.select(F.col("n_name").alias("case_id")))


# --- more of the pipeline's surface ---------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, p_size % 6 <> 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0 AS valid,
 CASE WHEN p_size % 6 = 0 THEN 'unknown document version' WHEN p_size % 7 = 0 THEN 'max_input_size_bytes must be > 0' WHEN p_size % 5 = 0 THEN 'profile cannot be empty' END AS problem FROM part"""
)
def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    text = F.concat(
        F.lit('{"version":"'), F.when(size % 6 == 0, "v0").otherwise("v1"), F.lit('","config":{"profile":"'), F.when(size % 5 == 0, "").otherwise(F.col("p_brand")),
        F.lit('","max_input_size_bytes":'), F.when(size % 7 == 0, "0").otherwise("5"), F.lit(',"max_output_size_bytes":7,"max_output_expansion_ratio":2.5,"blocked_extensions":["exe"]}}'),
    )
    return policy.policy_documents(table(spark, sf_dir, "part").select("p_partkey", text.alias("document"))).select("p_partkey", "valid", "problem")


@query(with_objects("""SELECT object_id, CASE WHEN stopped THEN 'pre_scan_blocked' ELSE kind END AS parser_used, CASE WHEN stopped THEN 'signature_match' ELSE 'reconstruction_level_not_met' END AS reason,
 CASE WHEN stopped THEN sha256(payload) END AS input_sha256, octet_length(payload)::BIGINT AS original_size FROM decided WHERE error IS NULL""", DETECTED_SQL, _FULL_SQL))
def quarantine_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of every blocked object, of all kinds."""
    out = pipeline.quarantine(pipeline.defend(derived_objects(spark, sf_dir), policy.policy_table(spark)))
    stopped = F.col("parser_used") == "pre_scan_blocked"
    return out.select("object_id", "parser_used", "reason", F.when(stopped, F.col("sha256")).alias("input_sha256"), "original_size")


@query(with_objects("""SELECT policy_id, coalesce(error, 'none') AS error, count(*)::BIGINT AS objects FROM (
  SELECT CASE tenant_id WHEN 't1' THEN 'strict' ELSE 'standard' END AS policy_id, coalesce(early_error, CASE WHEN len(hits) > 0 THEN NULL WHEN apart OR disagree THEN 'FileTypeMismatch'
    WHEN tenant_id = 't1' AND kind IN ('animated_image', 'other') THEN 'UnsupportedReconstructionLevel' WHEN tenant_id = 't1' AND kind IN ('image', 'gif', 'audio', 'video') THEN 'decoder' END) AS error FROM early) GROUP BY 1, 2""", DETECTED_SQL, _FULL_SQL.split("), decided AS")[0] + ")"))
def defend_for_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([("t1", 3, "strict"), ("t5", 9, None)], "tenant_id string, version long, policy string")
    objects = derived_objects(spark, sf_dir)
    out = pipeline.defend_for_tenants(objects, slots, policy.policy_table(spark))
    kind = F.when(F.col("error_kind").isin("Image", "Gif", "Audio", "Video", "Io"), "decoder").otherwise(F.coalesce("error_kind", F.lit("none")))
    return out.select(F.when(F.col("tenant_id") == "t1", "strict").otherwise("standard").alias("policy_id"), kind.alias("error")).groupBy("policy_id", "error").agg(F.count("*").alias("objects"))


_MIME_ROWS = sorted({m for ms in names.EXTENSION_OF_MIME.values() for m in ms} | {"text/plain", "image/apng"})


@query(f"SELECT event_id, {_case('mime', names.EXTENSION_OF_MIME)} AS extension FROM (SELECT event_id, ([{', '.join(repr(m) for m in _MIME_ROWS)}])[event_id % {len(_MIME_ROWS)} + 1] AS mime FROM events)")
def output_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.sources.sinks import output_extension as extension_of

    mime = F.element_at(F.array(*[F.lit(m) for m in _MIME_ROWS]), (F.col("event_id") % len(_MIME_ROWS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", extension_of(mime).alias("extension"))
