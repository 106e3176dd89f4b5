"""The queries of this package, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.llm import decontaminate, lines, merkle, mixing, mixture, ngrams, periods, quality, secrets, simhash, tokens, warc
from apexframe.llm.common import table


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.scores(table(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.binary_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[1]


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.get("positions", F.lit(0)).alias("first_position"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))[1]
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.spans(docs, secrets.trained(docs))
    return found.select(
        "doc_id", *[secrets.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_markov"))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similar_sets(table(spark, sf_dir, "documents")).drop("n_links")


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), change={"n_chars": F.when(tampered, chars + 1).otherwise(chars)})[1]
    folded = proofs.withColumn("folded_root", merkle.folded(F.col("changed"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic(table(spark, sf_dir, "documents"), periods.injected)
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_scores,
        "op2_simhash_near_dedup": simhash_near_dedup,
        "op3_token_id_output": binary_tokens,
        "op4_benchmark_decontamination": benchmark_decontamination,
        "op5_source_mixing": source_mixing,
        "op6_line_dedup": line_dedup,
        "op7_token_counts": token_counts,
        "op8_warc": warc_captures,
        "op9_quality_rules": quality_rules,
        "op10_secret_scan": secret_scan,
        "op11_ngram_join": ngram_join,
        "op12_merkle_manifest": merkle_manifest,
        "op13_periodic_runs": periodic_runs,
        "pipeline": importlib.import_module("corpus_pipeline").run,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
# CRC-32 (reflected polynomial 0xEDB88320) of the decimal id
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(cast(doc_id AS varchar))), lambda i: ascii(substr(cast(doc_id AS varchar), i, 1))::BIGINT)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} AS varchar)) || ':' || cast({value} AS varchar), '-')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) k),
hits AS (SELECT doc_id, i, di.n, item FROM di JOIN bw ON bw.n = di.n AND bw.g = array_to_string(list_slice(w, i, i + di.n - 1), ' ')),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) x GROUP BY 1),
places AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM hits) y GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN places USING (doc_id)""",
        "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
  strftime(make_timestamp((1577836800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM p LEFT JOIN f ON f.html = p.html""",
        "op11_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS id, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.id)
SELECT doc_id, cast(len(g) AS bigint) AS n_shingles, coalesce(top, doc_id) AS component_id
FROM s LEFT JOIN (SELECT id, min(top) AS top FROM r GROUP BY 1) x ON x.id = s.doc_id""",
        "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
  sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", f"(n_chars + CASE WHEN ({CRC}) % 7 = 0 THEN 1 ELSE 0 END)", "text"))}) AS changed FROM documents),
l AS (SELECT *, coalesce('s' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM d),
up AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL SELECT tree, level + 1, i, h, (n + 1) // 2 FROM (
    SELECT tree, level, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, n FROM up WHERE n > 1 GROUP BY tree, level, i // 2, n) x),
subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT level + 1, i, h, (n + 1) // 2 FROM (
    SELECT level, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, n FROM top WHERE n > 1 GROUP BY level, i // 2, n) x),
steps AS (SELECT l.tree, l.i, up.level, s.h, s.i < up.i AS before FROM l JOIN up ON up.tree = l.tree AND up.n > 1 AND up.i = l.i >> up.level
    LEFT JOIN up s ON s.tree = up.tree AND s.level = up.level AND s.i = xor(up.i, 1)
  UNION ALL SELECT l.tree, l.i, 100 + top.level, s.h, s.i < top.i FROM l JOIN subs USING (tree) JOIN top ON top.n > 1 AND top.i = subs.i >> top.level
    LEFT JOIN top s ON s.level = top.level AND s.i = xor(top.i, 1)),
proofs AS (SELECT tree, i, list({{'h': h, 'before': before}} ORDER BY level) AS steps FROM steps GROUP BY tree, i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(coalesce(steps, []), lambda s: s.h IS NOT NULL), lambda s: s.h), '')) AS proof_sha256,
  folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_prepend({{'h': changed, 'before': NULL}}, coalesce(steps, [])),
    lambda a, s: {{'h': CASE WHEN s.h IS NULL THEN sha256(a.h) WHEN s.before THEN sha256(s.h || a.h) ELSE sha256(a.h || s.h) END, 'before': NULL}}).h AS folded
  FROM l LEFT JOIN proofs USING (tree, i) JOIN subs s USING (tree)) x, (SELECT h AS root FROM top WHERE n = 1) y""",
    }
