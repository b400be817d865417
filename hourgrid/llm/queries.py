"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.audio import CODECS, decode_media, encode_texts
from hourgrid.llm.decontam import find_overlaps
from hourgrid.llm.filter_audit import audit_filters
from hourgrid.llm.fim import fill_in_middle, restored_text
from hourgrid.llm.html_main import extract_main_text
from hourgrid.llm.line_dedup import dedup_lines
from hourgrid.llm.mixing import mix_sources
from hourgrid.llm.quality import fit_quality, resample
from hourgrid.llm.secrets import NAMES, scan_secrets
from hourgrid.llm.simhash import near_duplicates
from hourgrid.llm.tokens import apply_edits, build_trees
from hourgrid.llm.toxicity import fit_toxicity, score_toxicity
from hourgrid.llm.url_filter import filter_urls, fit_urls, labelled_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, fit_quality(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "log_weight", "noisy_weight", "selected")


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in one of the three codecs, by its CRC, so that equal texts get equal files."""
    codec = F.element_at(F.array(*[F.lit(c) for c in CODECS]), (F.crc32(F.coalesce("text", F.lit(""))) % len(CODECS) + 1).cast("int"))
    media = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), codec=codec)
    return decode_media(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "pcm_bytes", "pcm_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document. The tables hold no reviewed findings, so labels
    follow a stated rule: a value assigned to a name of a credential is a finding (1), what
    no sign of assignment precedes is a false positive (0), anything else is unlabelled. Names
    and signs are hidden from the forest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    named, assigned = F.col("before").rlike(rf"{NAMES}$"), F.col("sign").rlike("[=:]")
    found = scan_secrets(docs, label=F.when(named & assigned, 1).when(~assigned, 0), hide=rf"{NAMES}$")
    return found.select("doc_id", "pos", F.sha2("candidate", 256).alias("candidate_sha256"), F.char_length("candidate").cast("long").alias("n_chars"), "label", "score", "is_secret")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document before and after two edits: its first line gives way to the name of
    its source, and its language is added at its end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    change = lambda start, length, text: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), text.alias("text"))
    n = F.coalesce(F.char_length("text"), F.lit(0))
    line = F.coalesce(F.char_length(F.substring_index("text", "\n", 1)), F.lit(0))
    edits = F.array(change(F.lit(0), line, F.col("source")), change(n, F.lit(0), F.concat(F.lit("\n"), F.col("lang"))))
    done = apply_edits(build_trees(docs.select("doc_id", "text", edits.alias("edits"))))
    return done.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), F.size("lens").cast("long").alias("n_leaves"), "n_encoded")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), (3.0, 1.0, 2.0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(restored_text(F.col("output"), F.col("form")), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), fit_urls(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_quality_resampling, op4_telephony_audio, op5_secret_scan, op6_main_text, op7_line_dedup, op8_simhash_near_dedup, op9_edit_aware_token_counts, op10_source_mixing, op11_fill_in_middle, op12_filter_audit, op13_url_filter)}


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, s.line, s.pos, lower_ascii AS k FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
  ) s, LATERAL (SELECT translate(regexp_replace(s.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
), shared AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM shared)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM shared)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(w)::BIGINT AS size, CASE WHEN len(w) > 1 THEN ln(len(list_distinct(w))::DOUBLE) / ln(len(w)::DOUBLE) ELSE 1.0::DOUBLE END AS varied,
    md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS h, coalesce(md5(text), '') AS m, length(text) AS n
  FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), k AS (
  SELECT *, ln(-ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))
    - ln(CASE WHEN size > 0 THEN greatest(varied / (1.0::DOUBLE + abs(n::DOUBLE / size::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE), 0.1::DOUBLE) ELSE 0.1::DOUBLE END) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1, 2][((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS goal FROM s
), g AS (
  SELECT *, sum(cap) OVER o + ratio * (sum(w) OVER () - sum(w) OVER o) <= goal AS is_full FROM f WINDOW o AS (ORDER BY ratio, cap, w ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least((goal - coalesce(sum(cap) FILTER (is_full) OVER (), 0.0)) / sum(w) FILTER (NOT is_full) OVER () * w, cap) END AS target FROM g
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND coalesce(sum(size) OVER p, 0) + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
WINDOW p AS (PARTITION BY k.source ORDER BY key, doc_id::VARCHAR, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), e AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), f AS (
  SELECT *, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT w.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), masks AS (
  SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, bad
), steps AS (
  SELECT filter_order, i::INT AS step, ascii(substr(filter_order, i, 1)) - 64 AS f, list_transform(range(1, i), lambda j: ascii(substr(filter_order, j, 1)) - 64) AS earlier FROM orders, range(1, 6) t(i)
), r AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT bad[f]) AS kept, sum(n) FILTER (NOT gone AND bad[f]) AS removed, sum(n) FILTER (gone AND bad[f]) AS redundant,
    sum(n) FILTER (bad[f] AND len(list_filter(bad, lambda x: x)) = 1) AS unique_fails, sum(good) FILTER (NOT gone AND bad[f]) AS good_lost, sum(toxic) FILTER (NOT gone AND bad[f]) AS toxic_lost
  FROM (SELECT masks.*, steps.*, len(list_filter(earlier, lambda j: bad[j])) > 0 AS gone FROM masks, steps) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": OP11_SQL, "op12_filter_audit": OP12_SQL, "op2_decontamination": OP2_SQL, "op7_line_dedup": OP7_SQL, "op10_source_mixing": OP10_SQL}
