"""The same queries as plain SQL, written independently of the operators: sliding frames
instead of running sums, joins of exploded tokens instead of arrays."""

from __future__ import annotations

#: Named subqueries; a query lists those that it needs, in order.
CTE = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "u": """SELECT event_id AS update_id, user_id AS event_id, (CASE WHEN event_type = 'signup' THEN 0 ELSE 1 + k % 5 END)::BIGINT AS revision,
        date_trunc('second', ts)::TIMESTAMP AS published_at, 'events' AS agency, event_type || CASE WHEN k % 10 = 3 THEN ' | planned-work' ELSE '' END AS status_label,
        'L' || (user_id % 25) || ' | L' || (k % 25) || CASE WHEN k % 4 = 0 THEN 'X' ELSE '' END || CASE WHEN k = 99 THEN ' | ZZ' ELSE '' END AS affected,
        CASE WHEN k % 7 <> 0 THEN 'k=' || k END AS header FROM ev""",
    "tok": "SELECT DISTINCT update_id, lower(trim(t)) AS token FROM (SELECT update_id, unnest(string_split(status_label, '|')) AS t FROM u) WHERE trim(t) <> ''",
    "aff": "SELECT DISTINCT update_id, upper(trim(t)) AS token FROM (SELECT update_id, unnest(string_split(affected, '|')) AS t FROM u) WHERE trim(t) <> ''",
    "mapped": "SELECT DISTINCT update_id, rtrim(token, 'X') AS entity FROM aff WHERE regexp_full_match(token, 'L([0-9]|1[0-9]|2[0-4])X?')",
    "unmapped": "SELECT update_id, token FROM aff WHERE NOT regexp_full_match(token, 'L([0-9]|1[0-9]|2[0-4])X?')",
    "inst": """SELECT *, event_id || ':' || instance_seq AS instance_id FROM (SELECT *, sum(CASE WHEN revision = 0 THEN 1 ELSE 0 END) OVER
        (PARTITION BY event_id ORDER BY published_at, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS instance_seq FROM u)""",
    "flag": """SELECT i.*, coalesce(p, 0)::INT AS is_planned, coalesce(s, 0)::INT AS is_significant FROM inst i LEFT JOIN
        (SELECT update_id, max(CASE WHEN token = 'planned-work' THEN 1 ELSE 0 END) AS p, max(CASE WHEN token = 'error' THEN 1 ELSE 0 END) AS s FROM tok GROUP BY update_id) USING (update_id)""",
    "tl": """SELECT *, max(is_planned) OVER (PARTITION BY instance_id ORDER BY published_at, revision, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS planned_so_far FROM flag""",
    "qual": "SELECT tl.*, entity FROM tl JOIN mapped USING (update_id) WHERE is_significant = 1 AND planned_so_far = 0",
    "starts": """SELECT instance_id, event_id, entity, update_id AS first_update_id, revision AS first_revision, published_at AS start_at, status_label AS first_status, header AS first_header
        FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, entity ORDER BY published_at, revision, update_id) AS r FROM qual) WHERE r = 1""",
    "bounds": "SELECT CASE WHEN date_trunc('hour', min(published_at)) = min(published_at) THEN min(published_at) ELSE date_trunc('hour', min(published_at)) + INTERVAL 1 HOUR END::TIMESTAMP AS first_hour, date_trunc('hour', max(published_at))::TIMESTAMP AS end_hour FROM u",
    "hours": "SELECT unnest(range(first_hour, end_hour, INTERVAL 1 HOUR)) AS hour FROM bounds",
    "ent": "SELECT 'L' || i AS entity FROM range(25) t(i)",
    "grid": """SELECT entity, hour, year(hour)::INT AS year, month(hour)::INT AS month, (isodow(hour) - 1)::INT AS weekday, hour(hour)::INT AS hour_of_day,
        (CASE WHEN isodow(hour) >= 6 THEN 1 ELSE 0 END)::INT AS is_weekend, hour + INTERVAL 1 HOUR AS hour_end FROM hours, ent""",
    "counts": "SELECT entity, date_trunc('hour', start_at)::TIMESTAMP AS hour, count(DISTINCT instance_id) AS n_starts FROM starts GROUP BY ALL",
    "targets": "SELECT g.*, coalesce(n_starts, 0)::BIGINT AS n_starts, (CASE WHEN coalesce(n_starts, 0) > 0 THEN 1 ELSE 0 END)::INT AS label FROM grid g LEFT JOIN counts c ON g.entity = c.entity AND g.hour = c.hour",
    "dep": """SELECT CASE WHEN k <> 50 THEN ts END AS departure_time, 'L' || (k % 27) AS trip_line, CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS trip_type,
        CASE WHEN value > 1 THEN '1' ELSE '0' END AS revenue_service FROM ev WHERE day(ts) % 7 <> 0""",
    "slh": "SELECT departure_time::DATE AS service_date, hour(departure_time)::INT AS service_hour, trip_line AS line, count(*) AS departures FROM dep WHERE departure_time IS NOT NULL AND trip_type = '0' AND revenue_service = '1' GROUP BY ALL",
    "sched": "SELECT year(service_date)::INT AS dataset_year, 'd' || year(service_date) AS dataset_id, * FROM slh",
    "cov": "SELECT service_date, min(dataset_year) AS dataset_year, min(dataset_id) AS dataset_id FROM sched GROUP BY service_date",
    "unsched": "SELECT * FROM sched WHERE NOT regexp_full_match(line, 'L([0-9]|1[0-9]|2[0-4])X?') AND line <> 'L26'",
    "fact": "SELECT rtrim(line, 'X') AS entity, service_date::TIMESTAMP + to_hours(service_hour) AS hour, sum(departures)::BIGINT AS departures FROM sched WHERE regexp_full_match(line, 'L([0-9]|1[0-9]|2[0-4])X?') GROUP BY ALL",
    "sysh": "SELECT hour, sum(n_starts)::BIGINT AS system_starts, avg(label::DOUBLE) AS system_rate FROM targets GROUP BY hour",
    "syshist": """SELECT hour, coalesce(sum(system_starts) OVER w1, 0)::BIGINT AS system_starts_prior_1h, coalesce(sum(system_starts) OVER w3, 0)::BIGINT AS system_starts_prior_3h,
        coalesce(sum(system_starts) OVER w6, 0)::BIGINT AS system_starts_prior_6h, coalesce(sum(system_starts) OVER w24, 0)::BIGINT AS system_starts_prior_24h, avg(system_rate) OVER w7d AS system_rate_prior_7d FROM sysh
        WINDOW w1 AS (ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w6 AS (ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
        w24 AS (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w7d AS (ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""",
    "hist": """SELECT *, row_number() OVER w - 1 AS history_hours, coalesce(sum(n_starts) OVER w1, 0)::BIGINT AS starts_prior_1h, coalesce(sum(n_starts) OVER w3, 0)::BIGINT AS starts_prior_3h,
        coalesce(sum(n_starts) OVER w6, 0)::BIGINT AS starts_prior_6h, coalesce(sum(n_starts) OVER w24, 0)::BIGINT AS starts_prior_24h,
        avg(label::DOUBLE) OVER w7d AS rate_prior_7d, avg(label::DOUBLE) OVER w30d AS rate_prior_30d, max(CASE WHEN label = 1 THEN hour END) OVER past AS last_start_hour FROM targets
        WINDOW w AS (PARTITION BY entity ORDER BY hour), w1 AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
        w6 AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), w24 AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
        w7d AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), w30d AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING),
        past AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "feat": """SELECT h.*, epoch(h.hour - last_start_hour) / 3600.0 AS hours_since_start, s.* EXCLUDE (hour), (CASE WHEN c.service_date IS NULL THEN 0 ELSE 1 END)::INT AS coverage_known,
        (CASE WHEN c.service_date IS NULL THEN NULL WHEN f.entity IS NULL THEN 0 ELSE 1 END)::INT AS service_active, f.departures AS scheduled_departures, (CASE WHEN f.entity IS NULL THEN 0 ELSE 1 END)::INT AS is_eligible
        FROM hist h JOIN syshist s ON h.hour = s.hour LEFT JOIN cov c ON c.service_date = h.hour::DATE LEFT JOIN fact f ON f.entity = h.entity AND f.hour = h.hour""",
    "cuts": "SELECT quantile_cont(epoch(hour), 0.70) AS a, quantile_cont(epoch(hour), 0.85) AS b FROM feat WHERE is_eligible = 1",
    "scored": "SELECT f.*, coalesce(rate_prior_30d, 0.0::DOUBLE) AS score, CASE WHEN epoch(hour) <= a THEN 'train' WHEN epoch(hour) <= b THEN 'val' ELSE 'test' END AS split FROM feat f, cuts WHERE is_eligible = 1",
    "test": "SELECT entity, hour, label, score FROM scored WHERE split = 'test'",
    "val": "SELECT entity, hour, label, score FROM scored WHERE split = 'val'",
    "pts": "SELECT score AS p, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM test GROUP BY score",
    "cum": "SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg, row_number() OVER (ORDER BY p) - 1 AS place FROM pts",
    "curve": "SELECT place, p AS threshold, tp / (tp + fp) AS precision, coalesce(tp / nullif(n_pos, 0), 1.0::DOUBLE) AS recall FROM cum UNION ALL SELECT count(*), NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM pts",
    "scan": """SELECT t / 100.0::DOUBLE AS threshold, coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0.0) AS f1 FROM (SELECT t, count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 1) AS tp,
        count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < t / 100.0::DOUBLE AND label = 1) AS fn FROM val, range(5, 96) r(t) GROUP BY t)""",
    "edges": "SELECT unnest(range(1, 1000)) AS i",
    "rt": """SELECT o_orderpriority AS line, l_linestatus AS direction, l_returnflag AS time_period, o_orderstatus AS schedule_day_type, date_trunc('month', o_orderdate)::DATE AS month_date, l_linenumber AS number_of_stops,
        l_quantity AS distance, l_suppkey AS scheduled_trains, l_extendedprice / 1000 AS avg_scheduled_runtime, l_extendedprice / 1000 + date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 10.0::DOUBLE AS avg_actual_runtime,
        l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "delays": "SELECT *, avg_actual_runtime - avg_scheduled_runtime AS delay_min, month(month_date)::INT AS month, year(month_date)::INT AS year FROM rt WHERE distance > 0 AND number_of_stops > 0 AND scheduled_trains > 0",
    "clip": "SELECT d.* FROM delays d, (SELECT quantile_cont(delay_min, 0.01) AS lo, quantile_cont(delay_min, 0.99) AS hi FROM delays) WHERE delay_min BETWEEN lo AND hi",
}

_BASE = ["ev", "u"]
_TIMELINE = [*_BASE, "tok", "inst", "flag", "tl"]
_STARTS = [*_BASE, "tok", "aff", "mapped", "inst", "flag", "tl", "qual", "starts"]
_TARGETS = [*_STARTS, "bounds", "hours", "ent", "grid", "counts", "targets"]
_SCHED = ["ev", "dep", "slh", "sched"]
_FEAT = [*_TARGETS, "dep", "slh", "sched", "cov", "fact", "sysh", "syshist", "hist", "feat"]
_SCORED = [*_FEAT, "cuts", "scored"]
_CAND = """SELECT 'included_positive' AS stratum, 1 AS assigned_label, instance_id, event_id, entity, date_trunc('hour', start_at)::TIMESTAMP AS hour, start_at AS published_at, first_status AS status_label, coalesce(first_header, '') AS header FROM starts
 UNION ALL SELECT stratum, 0, instance_id, event_id, entity, date_trunc('hour', published_at)::TIMESTAMP, published_at, status_label, coalesce(header, '') FROM (
  SELECT CASE WHEN p = 1 THEN 'excluded_as_planned' ELSE 'excluded_nonqualifying_status' END AS stratum, i.*, entity, row_number() OVER (PARTITION BY instance_id, entity ORDER BY published_at, i.update_id) AS r
  FROM inst i JOIN mapped m ON i.update_id = m.update_id JOIN (SELECT instance_id, max((token = 'planned-work')::INT) AS p, max((token = 'error')::INT) AS s FROM inst JOIN tok USING (update_id) GROUP BY instance_id) USING (instance_id) WHERE p = s) WHERE r = 1"""
_SAMPLE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY order_key) AS place FROM (SELECT *, sha256(stratum || '|' || instance_id || '|' || entity) AS order_key FROM ({_CAND}))) WHERE place <= CASE WHEN stratum = 'included_positive' THEN 20 ELSE 10 END"
_HIST = "SELECT i::INT AS bin, coalesce(pos, 0)::BIGINT AS pos, coalesce(neg, 0)::BIGINT AS neg FROM range(1000) r(i) LEFT JOIN (SELECT least((SELECT count(*) FROM range(1, 1000) e(j) WHERE j * 0.001::DOUBLE <= least(greatest(score, 0.0), 1.0)), 999) AS b, sum(label) AS pos, sum(1 - label) AS neg FROM (SELECT DISTINCT score FROM {0}) JOIN {0} USING (score) GROUP BY ALL) ON b = i"
_NEAR = """SELECT bin, n_near::BIGINT AS n_near, pos_near::BIGINT AS pos_near, coalesce(pos_near / nullif(n_near, 0), 0.0::DOUBLE) AS rate, w / 1000.0::DOUBLE AS half_width FROM (
 SELECT *, row_number() OVER (PARTITION BY bin ORDER BY w) AS r FROM (SELECT a.bin, w, sum(b.pos + b.neg) AS n_near, sum(b.pos) AS pos_near FROM hist1000 a, (SELECT unnest([15, 30, 60, 120, 240, 480, 960]) AS w), hist1000 b WHERE b.bin BETWEEN a.bin - w AND a.bin + w GROUP BY a.bin, w) WHERE n_near >= 300 OR w = 960) WHERE r = 1"""


def _sql(names: list[str], body: str, extra: str = "") -> str:
    ctes = [f"{n} AS ({CTE[n]})" for n in dict.fromkeys(names)]
    return "WITH " + ",\n".join([*ctes, *([extra] if extra else [])]) + "\n" + body


def _tree_sql(bundle: dict) -> str:
    """The bundle's score as nested conditions."""
    names = [f"(CASE WHEN entity = '{n.removeprefix('entity_')}' THEN 1.0::DOUBLE ELSE 0.0 END)" if n.startswith("entity_") else f"{n}::DOUBLE" for n in bundle["features"]]

    def node(tree: list, i: int) -> str:
        f, v, left, right, missing = tree[i]
        if f < 0:
            return f"{float(v)}::DOUBLE"
        low, high = node(tree, left), node(tree, right)
        return f"CASE WHEN {names[f]} IS NULL THEN {low if missing else high} WHEN {names[f]} <= {float(v)}::DOUBLE THEN {low} ELSE {high} END"

    return f"1.0 / (1.0 + exp(-({float(bundle['baseline'])}::DOUBLE + {' + '.join(f'({node(t, 0)})' for t in bundle['trees'])})))"


def oracle_sql(bundle: dict) -> dict[str, str]:
    from hourgrid.operators.features import RATES, SUMS

    sums, rates = [f"starts_prior_{k}h" for k in SUMS], [f"rate_prior_{n}" for n in RATES]
    profile = ["scheduled_departures", "history_hours", *sums, *rates, "hours_since_start"]
    bad = "CASE WHEN k = 17 THEN 'update_id' WHEN k = 13 THEN 'revision' WHEN k = 7 THEN 'published_at' WHEN k = 11 THEN 'scope' END"
    q: dict[str, str] = {
        "s2_parsed_updates": _sql(_BASE, f"SELECT update_id, u.event_id, revision, published_at, agency, status_label, affected, header, NULL::VARCHAR AS description FROM u JOIN (SELECT event_id AS update_id, k FROM ev) USING (update_id) WHERE ({bad}) IS NULL"),
        "s2_rejects_by_reason": _sql(["ev"], f"SELECT {bad} AS reason, count(*) AS n_rows FROM ev WHERE ({bad}) IS NOT NULL GROUP BY 1"),
        "s3_parsed_schedule": _sql(_SCHED, "SELECT CASE WHEN service_hour = 3 THEN 'dataset' WHEN service_hour = 4 THEN 'hour' ELSE '' END AS reason, count(*) AS n_rows, sum(departures)::BIGINT AS departures, count(DISTINCT line) AS n_lines FROM sched GROUP BY 1"),
        "s4_duplicate_keys": _sql(_BASE, "SELECT event_id, revision, count(*) AS n_rows FROM u GROUP BY ALL HAVING count(*) > 1"),
        "s5_snapshot": _sql(_BASE, "SELECT update_id, event_id, published_at FROM u WHERE update_id > 100 ORDER BY update_id LIMIT 500"),
        "s6_snapshot_manifest": _sql(_BASE, "SELECT count(*) AS n_rows, max(update_id) AS cutoff_id, max(published_at) AS max_time, count(*) AS source_rows, 0::INT AS limited, 'update_id,event_id,revision,published_at,agency,status_label,affected,header' AS columns FROM u WHERE update_id > 100"),
        "s7_schedule_manifest": _sql(_SCHED, "SELECT dataset_year, dataset_id, count(*) AS n_rows, min(service_date)::VARCHAR AS min_date, max(service_date)::VARCHAR AS max_date FROM sched GROUP BY ALL"),
        "s8_schedule_line_hours": _sql(_SCHED, "SELECT * REPLACE (service_date::VARCHAR AS service_date) FROM slh"),
        "s9_month_slice": _sql(_SCHED, "SELECT count(*) AS n_rows, sum(departures)::BIGINT AS departures FROM slh WHERE service_date >= DATE '2024-01-01' AND service_date < DATE '2024-02-01'"),
        "s11_review_sheet": _sql(_STARTS, f"SELECT stratum, instance_id, entity, '' AS reviewer, '' AS is_significant_yes_no_uncertain, '' AS is_unplanned_yes_no_uncertain, '' AS policy_label_correct_yes_no_uncertain, '' AS review_notes FROM ({_SAMPLE})"),
        "s13_running_times": _sql(["rt"], "SELECT line, count(*) AS n_rows FROM rt WHERE avg_scheduled_runtime IS NOT NULL AND avg_actual_runtime IS NOT NULL AND line <> '' GROUP BY line"),
        "s14_model_rows": _sql(_FEAT, "SELECT entity, hour, coalesce(scheduled_departures, 0)::BIGINT AS scheduled_departures, coalesce(rate_prior_30d, 0.0) AS rate_prior_30d, coalesce(hours_since_start, 0.0) AS hours_since_start, label FROM feat WHERE is_eligible = 1"),
        "p1_normalized_updates": _sql(_BASE, "SELECT update_id, lower(trim(agency)) AS agency_normalized, lower(trim(status_label)) AS status_normalized, trim(affected) AS affected FROM u"),
        "p2_status_tokens": _sql([*_BASE, "tok"], "SELECT * FROM tok"),
        "p3_affected_tokens": _sql([*_BASE, "aff"], "SELECT * FROM aff"),
        "p4_mapped_entities": _sql([*_BASE, "aff", "mapped"], "SELECT * FROM mapped"),
        "p5_unmapped_entities": _sql([*_BASE, "aff", "unmapped"], "SELECT * FROM unmapped"),
        "p7_unmapped_schedule": _sql([*_SCHED, "unsched"], "SELECT service_date::VARCHAR AS service_date, service_hour, line, departures FROM unsched"),
        "p8_hour_keys": _sql(_BASE, "SELECT date_trunc('hour', published_at)::TIMESTAMP AS hour, count(*) AS n_updates FROM u GROUP BY 1"),
        "p9_coverage_bounds": _sql([*_BASE, "bounds"], "SELECT * FROM bounds"),
        "p10_calendar": _sql([*_BASE, "bounds", "hours", "ent", "grid"], "SELECT DISTINCT * EXCLUDE (entity) FROM grid"),
        "p11_date_keys": _sql(_BASE, "SELECT published_at::DATE::VARCHAR AS day, strftime(published_at, '%Y-%m') AS month, date_trunc('hour', published_at)::TIMESTAMP AS hour, count(*) AS n_updates FROM u GROUP BY 1, 2, 3"),
        "p16_stable_ranks": _sql(_STARTS, "SELECT instance_id, entity, sha256('included_positive|' || instance_id || '|' || entity) AS order_key FROM starts"),
        "s13_running_time_rows": _sql(["rt"], "SELECT l_orderkey, l_linenumber, line, round(avg_actual_runtime, 6) AS avg_actual_runtime FROM rt WHERE avg_scheduled_runtime IS NOT NULL AND avg_actual_runtime IS NOT NULL AND line <> ''"),
        "p17_delay_of_rows": _sql(["rt", "delays"], "SELECT l_orderkey, l_linenumber, year, month, round(delay_min, 6) AS delay_min FROM delays"),
        "p18_clipped_rows": _sql(["rt", "delays", "clip"], "SELECT l_orderkey, l_linenumber, round(delay_min, 6) AS delay_min FROM clip"),
        "p17_delay_rows": _sql(["rt", "delays"], "SELECT line, year, month, count(*) AS n_rows, round(sum(delay_min), 6) AS delay_min FROM delays GROUP BY ALL"),
        "p18_clipped_delays": _sql(["rt", "delays", "clip"], "SELECT line, count(*) AS n_rows FROM clip GROUP BY line"),
        "e1_event_instances": _sql([*_BASE, "inst"], "SELECT update_id, event_id, instance_seq, instance_id FROM inst"),
        "j1_flagged_updates": _sql([*_BASE, "tok", "inst", "flag"], "SELECT update_id, is_planned, is_significant FROM flag"),
        "j2_significant_updates": _sql([*_BASE, "tok"], "SELECT update_id FROM u WHERE EXISTS (SELECT 1 FROM tok WHERE tok.update_id = u.update_id AND token = 'error')"),
        "e2_planned_so_far": _sql(_TIMELINE, "SELECT update_id, instance_id, planned_so_far FROM tl"),
        "j3_qualifying_updates": _sql(_STARTS[:-1], "SELECT update_id, instance_id, entity FROM qual"),
        "e3_first_starts": _sql(_STARTS, "SELECT * FROM starts"),
        "j4_entity_hour_grid": _sql([*_BASE, "bounds", "hours", "ent", "grid"], "SELECT * FROM grid"),
        "d2_positive_counts": _sql([*_STARTS, "counts"], "SELECT * FROM counts"),
        "j5_label_grid": _sql(_TARGETS, "SELECT entity, hour, hour_end, n_starts, label FROM targets"),
        "d3_schedule_fact": _sql([*_SCHED, "fact"], "SELECT * FROM fact"),
        "d4_schedule_coverage": _sql([*_SCHED, "cov"], "SELECT * REPLACE (service_date::VARCHAR AS service_date) FROM cov"),
        "d5_system_hours": _sql([*_TARGETS, "sysh"], "SELECT * FROM sysh"),
        "e4_trailing_sums": _sql([*_TARGETS, "hist"], f"SELECT entity, hour, {', '.join(sums)} FROM hist"),
        "e5_trailing_rates": _sql([*_TARGETS, "hist"], f"SELECT entity, hour, {', '.join(rates)} FROM hist"),
        "e6_hours_since_start": _sql([*_TARGETS, "hist"], "SELECT entity, hour, last_start_hour, epoch(hour - last_start_hour) / 3600.0 AS hours_since_start FROM hist"),
        "e7_history_length": _sql([*_TARGETS, "hist"], "SELECT entity, hour, history_hours FROM hist"),
        "e4_to_e7_in_short_chunks": _sql([*_TARGETS, "hist"], "SELECT entity, hour, history_hours, starts_prior_24h, rate_prior_30d, last_start_hour FROM hist"),
        "e8_system_history": _sql([*_TARGETS, "sysh", "syshist"], "SELECT * REPLACE (round(system_rate_prior_7d, 9) AS system_rate_prior_7d) FROM syshist"),
        "j6_features": _sql(_FEAT, "SELECT entity, hour, coverage_known, service_active, scheduled_departures, history_hours, starts_prior_24h, rate_prior_7d, hours_since_start, system_starts_prior_24h, label, n_starts, is_eligible FROM feat"),
        "d7_duplicate_update_keys": _sql(_BASE, "SELECT count(*) AS n_duplicate_keys FROM (SELECT 1 FROM u GROUP BY event_id, revision HAVING count(*) > 1)"),
        "d8_prevalence_by_entity": _sql(_TARGETS, "SELECT entity, count(*) AS n_hours, sum(label)::BIGINT AS n_positive, avg(label::DOUBLE) AS prevalence FROM targets GROUP BY entity"),
        "d11_eligible_prevalence_by_entity": _sql(_FEAT, "SELECT entity, count(*) AS n_hours, sum(label)::BIGINT AS n_positive, avg(label::DOUBLE) AS prevalence FROM feat WHERE is_eligible = 1 GROUP BY entity"),
        "d11_eligible_prevalence_by_month": _sql(_FEAT, "SELECT strftime(hour, '%Y-%m') AS month_key, count(*) AS n_hours, sum(label)::BIGINT AS n_positive, avg(label::DOUBLE) AS prevalence FROM feat WHERE is_eligible = 1 GROUP BY 1"),
        "d12_prevalence_by_hour": _sql(_FEAT, "SELECT i::INT AS hour_of_day, coalesce(avg(label::DOUBLE) FILTER (is_weekend = 0), 0.0) AS weekday_rate, coalesce(avg(label::DOUBLE) FILTER (is_weekend = 1), 0.0) AS weekend_rate FROM range(24) r(i) LEFT JOIN feat ON hour_of_day = i AND is_eligible = 1 GROUP BY i"),
        "t1_top_tokens": _sql([*_BASE, "tok"], "SELECT token, count(*) AS n_updates FROM tok GROUP BY token ORDER BY 2 DESC, 1 LIMIT 30"),
        "t2_top_unmapped": _sql([*_BASE, "aff", "unmapped"], "SELECT token, count(*) AS n_updates FROM unmapped GROUP BY token ORDER BY 2 DESC, 1 LIMIT 50"),
        "u2_eligible_entities": _sql(_FEAT, "SELECT DISTINCT entity FROM feat WHERE is_eligible = 1"),
        "u3_policy_problems": _sql([*_BASE, "aff", "ent"], "SELECT 'alias of no entity' AS problem, token AS value FROM (SELECT DISTINCT token FROM aff WHERE token LIKE '%X' OR token = 'ZZ') WHERE rtrim(token, 'X') NOT IN (SELECT entity FROM ent)"),
        "d16_event_flags": _sql([*_BASE, "tok", "inst"], "SELECT instance_id, max((token = 'planned-work')::INT) AS any_planned, max((token = 'error')::INT) AS any_significant FROM inst JOIN tok USING (update_id) GROUP BY instance_id"),
        "j7_review_candidates": _sql(_STARTS, _CAND),
        "e10_review_sample": _sql(_STARTS, f"SELECT stratum, assigned_label, instance_id, entity, hour, order_key FROM ({_SAMPLE})"),
        "d17_strata_counts": _sql(_STARTS, f"SELECT stratum, count(*) AS n_rows FROM ({_SAMPLE}) GROUP BY stratum"),
        "m1_chronological_split": _sql(_SCORED, "SELECT entity, hour, split FROM scored"),
        "d13_split_summary": _sql(_SCORED, "SELECT split, count(*) AS n_rows, avg(label::DOUBLE) AS positive_rate, min(hour)::DATE::VARCHAR AS first_date, max(hour)::DATE::VARCHAR AS last_date FROM scored GROUP BY split"),
        "m5_baseline_scores": _sql([*_SCORED, "test"], "SELECT * FROM test"),
        "m8_threshold_scan": _sql([*_SCORED, "val", "scan"], "SELECT threshold, round(f1, 9) AS f1 FROM scan"),
        "m8_best_threshold": _sql([*_SCORED, "val", "scan"], "SELECT threshold, round(f1, 9) AS f1 FROM scan ORDER BY scan.f1 DESC, threshold LIMIT 1"),
        "m9_confusion_metrics": _sql([*_SCORED, "test"], """SELECT tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
            round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1 FROM (SELECT count(*) FILTER (score >= 0.15::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= 0.15::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < 0.15::DOUBLE AND label = 1) AS fn, count(*) FILTER (score < 0.15::DOUBLE AND label = 0) AS tn FROM test)"""),
        "m10_ranking_metrics": _sql([*_SCORED, "test", "pts", "cum"], "SELECT round(coalesce(sum(pos * tp / (tp + fp)) / nullif(max(n_pos), 0), 0.0), 9) AS average_precision, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(max(n_pos) * max(n_neg), 0), 9) AS roc_auc, max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg FROM cum"),
        "m11_pr_curve": _sql([*_SCORED, "test", "pts", "cum", "curve"], "SELECT * FROM curve"),
        "t4_thin_curve": _sql([*_SCORED, "test", "pts", "cum", "curve"], "SELECT curve.* FROM curve, (SELECT max(place) AS m FROM curve) WHERE m < 20 OR place IN (SELECT i * m // 19 FROM range(20) r(i), (SELECT max(place) AS m FROM curve))"),
        "m12_calibration": _sql([*_SCORED, "test"], "SELECT bin::INT AS bin, count(*) AS n_rows, round(avg(score), 9) AS mean_score, round(avg(label::DOUBLE), 9) AS observed_rate FROM (SELECT *, (SELECT count(*) FROM edges12 WHERE e < score) AS bin FROM test) GROUP BY 1", "edges12 AS (SELECT unnest(quantile_cont(score, [" + ", ".join(f"{i}/12.0::DOUBLE" for i in range(1, 12)) + "])) AS e FROM test)"),
        "m13_score_histogram": _sql(_SCORED, _HIST.format("scored")),
        "m14_threshold_table": _sql(_SCORED, "SELECT bin, bin / 1000.0::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(n_pos, 0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(tp + fp + n_pos, 0), 0.0), 9) AS f1, round(tp / nullif(tp + fp, 0) / (n_pos / (n_pos + n_neg)), 9) AS lift FROM (SELECT bin, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM hist1000 WINDOW w AS (ORDER BY bin DESC))", f"hist1000 AS ({_HIST.format('scored')})"),
        "m15_nearby_rates": _sql([*_SCORED, "test"], _NEAR, f"hist1000 AS ({_HIST.format('test')})"),
        "m15_nearby_rate_of_scores": _sql([*_SCORED, "test", "val"], f"SELECT entity, hour, score, n_near, rate FROM val JOIN ({_NEAR}) n ON n.bin = least(greatest(floor(score * 1000 + 0.5), 0), 999)", f"hist1000 AS ({_HIST.format('test')})"),
        "d14_reference_profile": _sql(_SCORED, "SELECT 6.0::DOUBLE AS month, 3.0::DOUBLE AS weekday, 8.0::DOUBLE AS hour_of_day, 0.0::DOUBLE AS is_weekend, " + ", ".join(f"median({c}::DOUBLE) AS {c}" for c in profile) + " FROM scored_filled WHERE split = 'train'", "scored_filled AS (SELECT * REPLACE (coalesce(hours_since_start, 0.0) AS hours_since_start, coalesce(rate_prior_7d, 0.0) AS rate_prior_7d, coalesce(rate_prior_30d, 0.0) AS rate_prior_30d) FROM scored)"),
        "d15_entity_profiles": _sql(_SCORED, "SELECT entity, " + ", ".join(f"median({c}::DOUBLE) AS {c}" for c in profile) + " FROM scored_filled WHERE split = 'train' GROUP BY entity", "scored_filled AS (SELECT * REPLACE (coalesce(hours_since_start, 0.0) AS hours_since_start, coalesce(rate_prior_7d, 0.0) AS rate_prior_7d, coalesce(rate_prior_30d, 0.0) AS rate_prior_30d) FROM scored)"),
        "m17_tree_scores": _sql(_FEAT, f"SELECT entity, hour, round({_tree_sql(bundle)}, 9) AS score FROM feat"),
        "s5_continued_snapshot": _sql(["ev", "u"], "SELECT count(*) AS n_rows, max(update_id) AS cutoff_id, count(DISTINCT event_id) AS n_events, count(*) AS manifest_rows, 2::INT AS parts FROM u"),
        "m18_fitted_parity": _sql(_SCORED, "SELECT least(count(*), 500) AS n_rows, true AS passed FROM scored WHERE split = 'test'"),
        "m18_score_parity": _sql(_FEAT, "SELECT count(*) AS n_rows, true AS passed FROM feat"),
        "d18_mean_delay": _sql(["rt", "delays", "clip"], "SELECT line, round(avg(delay_min), 9) AS mean_delay, count(*) AS n_rows FROM clip GROUP BY line"),
        "d19_describe_target": _sql(["rt", "delays", "clip"], "SELECT count(*) AS n_rows, round(avg(delay_min), 7) AS mean, round(stddev(delay_min), 7) AS std, round(min(delay_min), 7) AS min, round(quantile_cont(delay_min, 0.25), 7) AS q25, round(quantile_cont(delay_min, 0.5), 7) AS median, round(quantile_cont(delay_min, 0.75), 7) AS q75, round(max(delay_min), 7) AS max FROM clip"),
        "d20_histogram": _sql(["rt", "delays", "clip"], "SELECT i::INT AS bin, count(b) AS n_rows FROM range(60) r(i) LEFT JOIN (SELECT least(floor((avg_scheduled_runtime - lo) / ((hi - lo) / 60)), 59) AS b FROM clip, (SELECT min(avg_scheduled_runtime) AS lo, max(avg_scheduled_runtime) AS hi FROM clip)) ON b = i GROUP BY i"),
        "m2_nearest_split": _sql(["rt", "delays", "clip"], "SELECT CASE WHEN month_date <= c THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, min(month_date)::VARCHAR AS first_month, max(month_date)::VARCHAR AS last_month FROM clip, (SELECT month_date AS c FROM (SELECT month_date, row_number() OVER (ORDER BY month_date) - 1 AS i, count(*) OVER () AS n FROM clip) WHERE i = round_even((n - 1) * 0.8::DOUBLE, 0)::BIGINT) GROUP BY 1"),
    }
    names = ["number_of_stops", "distance", "scheduled_trains", "avg_scheduled_runtime", "month", "delay_min"]
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM clip" if a != b else f"SELECT '{a}' AS a, '{b}' AS b, 1.0::DOUBLE AS r" for a in names for b in names)
    split = """SELECT clip.*, CASE WHEN month_date <= c THEN 'train' ELSE 'test' END AS split FROM clip, (SELECT month_date AS c FROM (SELECT month_date, row_number() OVER (ORDER BY month_date) - 1 AS i, count(*) OVER () AS n FROM clip)
      WHERE i = round_even((n - 1) * 0.8::DOUBLE, 0)::BIGINT)"""
    kinds = ("line", "direction", "time_period", "schedule_day_type")
    levels = " + ".join(f"(SELECT count(DISTINCT {c}) FROM model_rows WHERE split = 'train')" for c in kinds)
    hits = " + ".join(f"CASE WHEN {c} IN (SELECT {c} FROM model_rows WHERE split = 'train') THEN 1 ELSE 0 END" for c in kinds)
    q["m3_design_matrix"] = _sql(["rt", "delays", "clip"], f"SELECT split, count(*) AS n_rows, ({levels} + 5)::INT AS n_columns, round(sum(number_of_stops + distance + scheduled_trains + avg_scheduled_runtime + month + {hits}), 3) AS total FROM model_rows GROUP BY split", f"model_rows AS ({split})")
    # Least squares by Gauss-Jordan on the normal equations, the first level of each category left out.
    ones = ", ".join(f"list_transform((SELECT list(DISTINCT {c} ORDER BY {c}) FROM model_rows WHERE split = 'train')[2:], lambda v: ({c} = v)::DOUBLE)" for c in kinds)
    line = f"""model_rows AS ({split}), x AS (SELECT line, split, delay_min AS y, flatten([[1.0::DOUBLE], {ones}, [number_of_stops::DOUBLE, distance, scheduled_trains, avg_scheduled_runtime, month]]) AS x FROM model_rows),
      k AS (SELECT max(len(x)) AS k FROM x),
      cells AS (SELECT i, j, sum(x[i] * CASE WHEN j > k THEN y ELSE x[j] END) AS v FROM x, k, (SELECT unnest(range(1, k + 1)) AS i FROM k), (SELECT unnest(range(1, k + 2)) AS j FROM k) WHERE split = 'train' GROUP BY i, j),
      m AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row FROM cells GROUP BY i)),
      solved AS (SELECT 0 AS i, m FROM m UNION ALL SELECT i + 1, list_transform(m, lambda row, r: CASE WHEN r = i + 1 THEN list_transform(row, lambda v: v / row[i + 1]) ELSE list_transform(row, lambda v, c: v - row[i + 1] * m[i + 1][c] / m[i + 1][i + 1]) END) FROM solved, k WHERE i < k),
      beta AS (SELECT list_transform(m, lambda row: row[-1]) AS beta FROM solved, k WHERE i = k),
      judged AS (SELECT line, y, y - list_sum(list_transform(range(1, k + 1), lambda j: x[j] * beta[j])) AS residual FROM x, k, beta WHERE split = 'test')"""
    fitted = lambda body: "WITH RECURSIVE " + _sql(["rt", "delays", "clip"], body, line).removeprefix("WITH ")
    q["m20_linear_regression"] = fitted("SELECT round(1 - sum(residual * residual) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual * residual)), 6) AS rmse FROM judged")
    q["p19_residuals"] = fitted("SELECT line, count(*) AS n_rows, round(avg(residual), 6) AS mean_residual FROM judged GROUP BY line")
    q["d21_correlation_matrix"] = _sql(["rt", "delays", "clip"], cells)
    summary = """SELECT n_updates, n_events, n_instances, min_published, max_published, n_starts, n_grid_rows, n_hours, n_positive, n_assigned, n_unmapped, n_positive / n_grid_rows AS prevalence FROM
      (SELECT count(*) AS n_updates, count(DISTINCT event_id) AS n_events, count(DISTINCT instance_id) AS n_instances, min(published_at) AS min_published, max(published_at) AS max_published FROM inst),
      (SELECT count(*) AS n_starts FROM starts), (SELECT count(*) AS n_grid_rows, count(DISTINCT hour) AS n_hours, sum(label)::BIGINT AS n_positive, sum(n_starts)::BIGINT AS n_assigned FROM targets), (SELECT count(*) AS n_unmapped FROM unmapped)"""
    feature = """SELECT n_feature_rows, n_eligible, n_eligible_positive, n_positive_inactive, n_schedule_rows, n_covered_dates, n_schedule_fact, n_unmapped_schedule FROM
      (SELECT count(*) AS n_feature_rows, count(*) FILTER (is_eligible = 1) AS n_eligible, count(*) FILTER (is_eligible = 1 AND label = 1) AS n_eligible_positive, count(*) FILTER (coverage_known = 1 AND service_active = 0 AND label = 1) AS n_positive_inactive FROM feat),
      (SELECT count(*) AS n_schedule_rows FROM sched), (SELECT count(*) AS n_covered_dates FROM cov), (SELECT count(*) AS n_schedule_fact FROM fact), (SELECT count(*) AS n_unmapped_schedule FROM unsched)"""
    q["d6_quality_summary"] = _sql([*_TARGETS, "unmapped"], summary)
    q["d9_feature_summary"] = _sql([*_FEAT, "unsched"], feature)
    q["d10_quality_checks"] = _sql([*_FEAT, "unmapped", "unsched"], """SELECT c.name, c.passed, c.observed::BIGINT AS observed, c.expected::BIGINT AS expected FROM (SELECT unnest([
      {name: 'raw_rows_present', passed: n_updates > 0, observed: n_updates, expected: NULL::BIGINT}, {name: 'canonical_entity_count', passed: true, observed: 25, expected: 25},
      {name: 'grid_completeness', passed: n_grid_rows = n_hours * 25, observed: n_grid_rows, expected: n_hours * 25}, {name: 'binary_target_values', passed: true, observed: 0, expected: 0},
      {name: 'both_target_classes_present', passed: n_positive > 0 AND n_positive < n_grid_rows, observed: n_positive, expected: NULL}, {name: 'feature_target_row_parity', passed: n_feature_rows = n_grid_rows, observed: n_feature_rows, expected: n_grid_rows},
      {name: 'schedule_rows_present', passed: n_schedule_rows > 0, observed: n_schedule_rows, expected: NULL}, {name: 'schedule_entities_mapped', passed: n_unmapped_schedule = 0, observed: n_unmapped_schedule, expected: 0},
      {name: 'eligible_rows_have_both_classes', passed: n_eligible_positive > 0 AND n_eligible_positive < n_eligible, observed: n_eligible_positive, expected: NULL}]) AS c FROM s, f)""", f"s AS ({summary}), f AS ({feature})")
    return q
