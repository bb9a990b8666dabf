"""The thin ``opN_*`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, html_text, langid, lexical, licenses, linededup, mixing, packing, quality, simhash, spelling, suffixdedup, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3, lanes=1, parts=3, size_ratio=None)
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stand in training order: ``position`` is a document's first (1 is the end; null: never taken)."""
    mixed = mixing.by_first_position(mixing.mix(_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.analyse(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_multiprobe_lsh, op3_warc_round_trip, op4_html_text, op5_language_id,
        op6_simhash_near_dedup, op7_curriculum_mixing, op8_quality_rules, op9_line_dedup, op10_license_scan,
        op11_spelling_variants, op12_ranked_search, op13_suffix_array_dedup,
    )
}

ORACLE = {
    "op3_warc_round_trip": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM g""",
    "op7_curriculum_mixing": """
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
                  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
             sum(cap) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) AS caps,
             sum(w) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) AS seen FROM r),
l AS (SELECT *, (total - (caps - cap)) / (ws - (seen - w)) AS level FROM c),
f AS (SELECT min_by(level, seen) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, (rk - 1) % 3 AS schedule, coalesce(least(cap, f.level * w), cap) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.schedule,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (passes + CASE WHEN source_size > 0 AND before + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken,
       CASE WHEN source_size > 0 AND (passes > 0 OR before + size / 2.0 < target) THEN round(greatest(0, least(1, CASE schedule
         WHEN 0 THEN before / target
         WHEN 1 THEN 1.5 - sqrt(2.25 - 2 * (before / target))
         ELSE CASE WHEN before / target < 1 / 3.0 THEN 1.5 * (before / target) ELSE 0.5 + (sqrt(0.25 + 3 * (before / target - 1 / 3.0)) - 0.5) / 2 END END)), 9) END AS position
FROM p""",
    "op9_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_ranked_search": """
WITH t AS (SELECT doc_id, rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
           FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
f AS (SELECT doc_id, rn, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT rn, sum(tf)::BIGINT AS n FROM f GROUP BY rn),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
m AS (SELECT rn, 100 - 90 + (90 * n * n_docs) // total AS m FROM d, c),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, rn, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (rn) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
