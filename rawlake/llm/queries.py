"""The queries of these operators over the given tables, with their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.llm import decontaminate, divergence, language, line_runs, merkle, mixing, near_dups, packing, quality, sharding, substrings, suffixes, warc
from rawlake.llm.common import stage, text_of
from rawlake.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("r1", "r2")


@query
def op2_genetic_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY))
    crc = F.crc32("ids").cast("bigint").alias("ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", crc, "sequence_id", "offset")


@query
def op3_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.score_documents(table(spark, sf, "documents"))


@query
def op4_warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark)
    warc.write_archive(table(spark, sf, "pages"), path)
    rows = warc.captures(warc.read_records(spark, path), keep_payload=False)
    rows = stage(rows.withColumn("page_id", warc.page_id(rows)))
    return warc.resolved(rows, "page_id").select(
        "page_id",
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        F.col("record.type").alias("record_type"),
        F.col("first_page_id").alias("refers_to"),
    )


@query
def op5_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    out = suffixes.dedup_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_sketched_substrings(spark: SparkSession, sf: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_odd_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents")).drop("r1", "r2")


@query
def op10_minimax_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.crc32(text_of()).cast("bigint").alias("text_crc32"))
    out = sharding.shard_documents(docs, carry=("text_crc32",))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_slot_pivot(spark: SparkSession, sf: str) -> DataFrame:
    values = {f: F.col(f) for f in merkle.FIELDS}
    tampered = merkle.leaf_digest(*(values | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = merkle.manifest(table(spark, sf, "documents"), carry={"tampered": F.when(hit, tampered)})
    root = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    proof = merkle.sibling_digest(F.col("path")).alias("proof_sha256")
    out = found.select("doc_id", "leaf", "subroot", "root", proof, root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_pointer_sort(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


@query
def op13_subword_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    model = language.learn(docs.where(part != 1).select("text", "lang"))
    found = language.identify(docs, model)
    return found.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score", "accepted")


SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op4_warc_transactions"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> first AS again FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""

ORACLE["op6_line_runs"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

WORDS_SQL = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE["op7_suffix_arrays"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n FROM h),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(n - 49)) AS p FROM b WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM g, range(50) t(o)),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (e) AS n_spans FROM
  (SELECT doc_id, p - lag(p, 1, -2) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS e FROM c) GROUP BY doc_id),
a AS (SELECT doc_id, x, unnest(range(n)) AS p FROM b WHERE doc_id IN (SELECT doc_id FROM r)),
k AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2), '' ORDER BY p) AS x FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN b.x ELSE coalesce(k.x, '') END)) AS kept_sha256
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLE["op8_sketched_substrings"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents),
w AS (SELECT doc_id, p, list_slice(w, p, p + 49) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM g, range(50) t(o)),
u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT u.*, c.p IS NOT NULL AS gone FROM u LEFT JOIN c USING (doc_id, p)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(t, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE["op9_odd_sketches"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b USING (g) WHERE a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

FIELD_SQL = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
# bit by bit over the characters of a decimal number
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))))"""

ORACLE["op11_slot_pivot"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {LEAF_SQL.format(FIELD_SQL.format("text"))} AS leaf,
    {LEAF_SQL.format(FIELD_SQL.format("replace(text, chr(10), '')"))} AS cut, {CRC_SQL.format("doc_id")} % 2 = 0 AS hit FROM documents),
g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS sources FROM (SELECT DISTINCT source FROM d)),
e AS (SELECT d.*, s, sources, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT 0 AS lvl, s, i, n, leaf AS h FROM e
  UNION ALL SELECT lvl + 1, s, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, s, i // 3),
u AS (SELECT s, lvl AS depth, h FROM t WHERE n = 1),
v AS (SELECT 0 AS lvl, s AS i, (SELECT count(*) FROM g) AS n, h FROM u
  UNION ALL SELECT lvl + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY lvl, i // 3),
k AS (SELECT 0 AS up, s, lvl, i, n, h FROM t UNION ALL SELECT 1, -1, lvl, i, n, h FROM v),
b AS (SELECT a.up, a.s, a.lvl, a.i, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < a.i), '') AS l,
    coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > a.i), '') AS r
  FROM k a JOIN k o ON a.up = o.up AND a.s = o.s AND a.lvl = o.lvl AND a.i // 3 = o.i // 3 WHERE a.n > 1 GROUP BY ALL),
f AS (SELECT s, i, 0 AS up, s AS tree, 0 AS lvl, i AS pos, CASE WHEN hit THEN cut ELSE leaf END AS h, '' AS proof, false AS done FROM e
  UNION ALL
  SELECT f.s, f.i, CASE WHEN b.i IS NULL THEN 1 ELSE f.up END, CASE WHEN b.i IS NULL THEN -1 ELSE tree END,
    CASE WHEN b.i IS NULL THEN 0 ELSE f.lvl + 1 END, CASE WHEN b.i IS NULL THEN f.s ELSE pos // 3 END,
    CASE WHEN b.i IS NULL THEN h ELSE sha256(l || h || r) END, CASE WHEN b.i IS NULL THEN proof ELSE proof || l || r END, b.i IS NULL AND f.up = 1
  FROM f LEFT JOIN b ON b.up = f.up AND b.s = f.tree AND b.lvl = f.lvl AND b.i = f.pos WHERE NOT done),
w AS (SELECT s, i, h AS folded_root, sha256(proof) AS proof_sha256 FROM f WHERE done),
z AS (SELECT h AS root FROM v WHERE n = 1)
SELECT doc_id, leaf, u.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM e JOIN w USING (s, i) JOIN u USING (s), z
"""

ORACLE["op12_pointer_sort"] = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, {LOWER_SQL.format("unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, term FROM g JOIN k USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT a.*, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v
  FROM a LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST(1000000000 * CAST(n + 5 AS HUGEINT) // (sum(n) OVER l + 5 * count(*) OVER l) AS BIGINT) AS q FROM k WINDOW l AS (PARTITION BY lang)),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 * CAST(n + 5 AS HUGEINT) // (total + 5 * v) AS BIGINT) AS p FROM m),
x AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""
