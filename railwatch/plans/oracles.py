"""Plain SQL for the registered queries, over the same source tables.

The statements say what each query means without the bucketing and staging the
jobs use; they are run by another engine to check results.
"""

from __future__ import annotations


def _z(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR count({column}) OVER w < 2 THEN NULL "
        f"WHEN min({column}) OVER w = max({column}) OVER w THEN "
        f"CASE WHEN {column} = min({column}) OVER w THEN 0.0 ELSE 5.0 END "
        f"ELSE ({column} - avg({column}) OVER w) / stddev_samp({column}) OVER w END"
    )


def _drift(*columns: str) -> str:
    total = " + ".join(f"coalesce(abs({c}), 0)" for c in columns)
    count = " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)
    return f"CASE WHEN {count} > 0 THEN least(({total}) / ({count}), 5.0) / 5.0 * 100.0 END"


_WEEKS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_LEVEL = (
    "CASE WHEN {0} >= 85 THEN 'Critical' WHEN {0} >= 60 THEN 'High' WHEN {0} >= 35 THEN 'Medium' ELSE 'Low' END"
)
_BAND = (
    "CASE WHEN {0} < 30 THEN 'Normal' WHEN {0} < 60 THEN 'Low-Medium' WHEN {0} < 80 THEN 'High' ELSE 'Critical' END"
)
_LABEL = """CASE {0} WHEN 'NETWORK_TIMEOUT_SPIKE' THEN 'Failure-rate spike' WHEN 'BATCH_NOT_SETTLED' THEN 'Batch never settles'
 WHEN 'DUPLICATE_PAYMENT' THEN 'Duplicate payment' WHEN 'FORMAT_REJECTION' THEN 'Formatting rejection'
 WHEN 'FORMAT_REJECTION_SPIKE' THEN 'Formatting rejection spike' WHEN 'CONFIRMED_BREAK' THEN 'Confirmed reconciliation break'
 WHEN 'PROVISIONAL_VARIANCE' THEN 'Provisional reconciliation variance' WHEN 'FRAUD_HIGH' THEN 'Fraud High'
 WHEN 'FRAUD_CRITICAL' THEN 'Fraud Critical' END"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_DIGIT = "ascii(substr(md5({0}), {1}, 1))"

CTES = {
    "base": """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, (user_id // 3) % 5 AS cohort,
 date_trunc('second', ts)::TIMESTAMP AS ots FROM events""",
    "ev": """SELECT event_id AS event_ordinal, k, user_id, event_type, ots, 'BANK_' || (user_id % 3) AS tenant_bank_id,
 CASE event_type WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'WIRE' WHEN 'purchase' THEN 'CARD' WHEN 'signup' THEN 'FEDNOW' WHEN 'error' THEN 'CHEQUE' END AS rail_type,
 'TXN-' || event_id AS transaction_id,
 CASE WHEN k % 3 <> 0 THEN 'PARTY-' || user_id END AS payer_name,
 'PAYEE-' || ((event_id * 7 + k) % 40) AS payee_name,
 CASE WHEN k % 2 <> 0 THEN '****' || lpad(((event_id * 7 + k) % 40)::VARCHAR, 4, '0') END AS payee_account_ref,
 value * 100 AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS transaction_occurred_at,
 CASE WHEN k % 10 < 7 THEN 'SETTLED' WHEN k % 10 = 7 THEN 'FAILED' WHEN k % 10 = 8 THEN 'PENDING' END AS status,
 CASE WHEN cohort < 3 THEN 'M' || user_id END AS source_merchant_id,
 CASE WHEN cohort >= 3 OR k % 25 = 0 THEN 'I' || user_id END AS source_individual_id,
 CASE WHEN cohort < 3 THEN 'MER-' || user_id END AS merchant_id,
 CASE WHEN cohort >= 3 THEN 'IND-' || user_id END AS individual_id,
 k % 20 = 3 AS is_retry, CASE WHEN k % 20 = 3 THEN 'TXN-' || (event_id - 1) END AS original_transaction_id,
 CASE WHEN NOT (k % 20 = 3 AND k >= 60) THEN 'IDEM-' || (CASE WHEN k % 20 = 3 THEN event_id - 1 ELSE event_id END) END AS idempotency_key,
 CASE WHEN k % 29 = 0 THEN NULL WHEN k % 13 = 0 THEN 'FAILED' ELSE 'PASSED' END AS format_validation_status,
 CASE WHEN k % 4 = 0 THEN NULL WHEN k % 11 = 0 THEN 'BREAK' WHEN k % 7 = 0 THEN 'NOT_YET_RECONCILED' ELSE 'MATCHED' END AS reconciliation_status,
 CAST(CASE WHEN k % 4 = 0 THEN NULL WHEN k % 11 = 0 THEN CASE WHEN k % 2 = 0 THEN 0 ELSE k - 50 END
  WHEN k % 7 = 0 THEN CASE WHEN k % 3 = 0 THEN k ELSE 0 END ELSE 0 END AS DOUBLE) AS reconciliation_variance_amount,
 (100 + 10 * k)::DOUBLE AS response_ms, 100 + 10 * k > 900 AS timed_out, k > 80 AS network_timeout_flag,
 'BATCH-' || event_type || '-' || strftime(ts, '%Y%m%d') || '-' || (user_id % 3) AS batch_id,
 (ts::DATE + 2)::TIMESTAMP AS expected_ts, k >= 2 AS file_reached_settlement,
 CASE WHEN k % 9 = 0 THEN NULL ELSE k % 5 = 0 END AS fraud_flag,
 CASE WHEN cohort < 3 THEN 'MER-' || user_id ELSE 'IND-' || user_id END AS party_id,
 CASE WHEN cohort < 3 THEN 'MERCHANT' ELSE 'INDIVIDUAL' END AS party_type FROM base""",
    "prof": """SELECT tenant_bank_id, party_type, party_id, count(*) AS pn, min(ots) AS first_seen, max(ots) AS last_seen
 FROM ev GROUP BY ALL""",
    "cut": """SELECT tenant_bank_id, list_sort(list(ots))[least(count(*) - 1, floor(count(*) * 0.8::DOUBLE)::BIGINT) + 1] AS cutoff
 FROM ev GROUP BY 1 HAVING count(*) >= 5""",
    "win": """SELECT ev.*, first_seen, last_seen, CASE WHEN ev.party_type = 'MERCHANT' AND pn >= 15 THEN 'WEEKLY' ELSE 'TO_DATE' END AS window_type,
 CASE WHEN ev.party_type = 'MERCHANT' AND pn >= 15 THEN date_trunc('week', ots)::TIMESTAMP END AS window_start
 FROM ev JOIN prof USING (tenant_bank_id, party_type, party_id)""",
    "snap0": """SELECT tenant_bank_id, party_id, party_type, window_type, window_start, first_seen, last_seen, count(*) AS transaction_count,
 sum(amount) AS amount_total, avg(amount) AS amount_avg, median(amount) AS amount_median,
 CASE WHEN count(amount) = 1 THEN 0.0 ELSE stddev_samp(amount) END AS amount_std,
 count(DISTINCT payee_name) AS unique_counterparties, count(DISTINCT payee_name) / count(payee_name) AS new_counterparty_ratio,
 avg(is_retry::INT) AS retry_ratio, avg(response_ms) AS avg_response_time_ms, avg(timed_out::INT) AS timeout_ratio,
 avg((format_validation_status = 'FAILED')::INT) AS format_reject_ratio,
 avg((amount >= 9000 AND amount < 10000)::INT) AS near_threshold_ratio,
 array_to_string(list_sort(list(DISTINCT rail_type)), ',') AS rails_used FROM win GROUP BY ALL""",
    "snap1": f"""SELECT s.*, party_type AS segment, cutoff,
 CASE WHEN window_type = 'WEEKLY' THEN window_start + INTERVAL 7 DAY ELSE last_seen END AS window_end,
 concat_ws('|', tenant_bank_id, party_id, window_type, coalesce({_ISO.format('window_start')}, 'TO_DATE')) AS snapshot_id,
 CASE WHEN window_type = 'WEEKLY' AND window_start >= cutoff THEN 'test' ELSE 'train' END AS split
 FROM snap0 s LEFT JOIN cut USING (tenant_bank_id)""",
    "snap2": f"""SELECT *, (epoch_us(window_end) - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS account_age_days,
 {_z('amount_total')} AS z1, {_z('transaction_count')} AS z2, {_z('new_counterparty_ratio')} AS z3,
 {_z('timeout_ratio')} AS zt, {_z('format_reject_ratio')} AS zf, count(timeout_ratio) OVER w AS weeks_before
 FROM snap1 WINDOW w AS (PARTITION BY tenant_bank_id, party_id, window_type ORDER BY window_start {_WEEKS})""",
    "snap": f"""SELECT *, CASE WHEN window_type = 'WEEKLY' THEN {_drift('z1', 'z2', 'z3')} END AS timeseries_drift_score FROM snap2""",
    "banded": f"""SELECT *, coalesce(timeseries_drift_score, 0.0) AS final_anomaly_score,
 {_BAND.format('coalesce(timeseries_drift_score, 0.0)')} AS anomaly_band FROM snap""",
    "flagged": "SELECT * FROM banded WHERE anomaly_band IN ('High', 'Critical')",
    "p75": """SELECT tenant_bank_id, segment,
 list_sort(list(new_counterparty_ratio) FILTER (new_counterparty_ratio IS NOT NULL)) AS a,
 list_sort(list(near_threshold_ratio) FILTER (near_threshold_ratio IS NOT NULL)) AS b,
 list_sort(list(timeseries_drift_score) FILTER (timeseries_drift_score IS NOT NULL)) AS c FROM snap GROUP BY ALL""",
    "thresholds": """SELECT tenant_bank_id, segment,
 a[least(len(a) - 1, floor(len(a) * 0.75::DOUBLE)::BIGINT) + 1] AS ta, b[least(len(b) - 1, floor(len(b) * 0.75::DOUBLE)::BIGINT) + 1] AS tb,
 c[least(len(c) - 1, floor(len(c) * 0.75::DOUBLE)::BIGINT) + 1] AS tc FROM p75""",
    "tagged": """SELECT s.*, concat_ws(',', CASE WHEN ta > 0 AND new_counterparty_ratio >= ta THEN 'New Payee Risk' END,
 CASE WHEN tb > 0 AND near_threshold_ratio >= tb THEN 'Structuring' END,
 CASE WHEN tc > 0 AND timeseries_drift_score >= tc THEN 'Velocity Checks' END) AS categories
 FROM banded s LEFT JOIN thresholds USING (tenant_bank_id, segment)""",
    "paid": """SELECT tenant_bank_id, coalesce(payee_account_ref, payee_name) AS beneficiary_key, coalesce(party_id, payer_name) AS sender,
 party_type, payee_name, amount, event_ordinal, ots, date_trunc('week', ots)::TIMESTAMP AS window_start FROM ev WHERE payee_name IS NOT NULL""",
    "firsts": "SELECT tenant_bank_id, beneficiary_key, sender, min(window_start) AS first_week FROM paid GROUP BY ALL",
    "ben0": """SELECT p.tenant_bank_id, p.beneficiary_key, p.window_start, arg_max(payee_name, (ots, event_ordinal)) AS beneficiary_name,
 count(*) AS transaction_count, sum(amount) AS amount_total, count(DISTINCT p.sender) AS distinct_senders,
 count(DISTINCT CASE WHEN first_week = p.window_start THEN p.sender END) AS distinct_new_senders,
 array_to_string(list_sort(list(DISTINCT party_type)), ',') AS sender_party_types
 FROM paid p JOIN firsts f USING (tenant_bank_id, beneficiary_key, sender) GROUP BY ALL""",
    "ben1": f"""SELECT *, window_start + INTERVAL 7 DAY AS window_end, distinct_new_senders / distinct_senders AS new_sender_ratio,
 concat_ws('|', tenant_bank_id, beneficiary_key, {_ISO.format('window_start')}) AS snapshot_id FROM ben0""",
    "ben2": f"""SELECT *, {_z('distinct_senders')} AS z1, {_z('new_sender_ratio')} AS z2 FROM ben1
 WINDOW w AS (PARTITION BY tenant_bank_id, beneficiary_key ORDER BY window_start {_WEEKS})""",
    "ben": f"SELECT *, {_drift('z1', 'z2')} AS funnel_drift_score FROM ben2",
    "shared": """SELECT tenant_bank_id, idempotency_key AS link_key, count(*) AS member_count,
 count(*) FILTER (status = 'SETTLED') AS settled_count, arg_min(transaction_id, event_ordinal) FILTER (status = 'SETTLED') AS reference_id
 FROM ev WHERE idempotency_key IS NOT NULL GROUP BY ALL""",
    "pairs": """SELECT r.tenant_bank_id, 'RETRY-LINK:' || o.transaction_id AS link_key, r.transaction_id AS rt, r.status AS rs, r.event_ordinal AS ro,
 o.transaction_id AS ot, o.status AS os, r.rail_type AS rr, o.rail_type AS orr FROM ev r JOIN ev o ON o.tenant_bank_id = r.tenant_bank_id AND o.transaction_id = r.original_transaction_id
 WHERE r.is_retry AND NOT (r.idempotency_key IS NOT NULL AND r.idempotency_key IS NOT DISTINCT FROM o.idempotency_key)""",
    "linked": """SELECT tenant_bank_id, link_key, count(*) + 1 AS member_count,
 count(*) FILTER (rs = 'SETTLED') + max(coalesce(os = 'SETTLED', false)::INT) AS settled_count,
 CASE WHEN coalesce(arg_min(coalesce(rs, ''), ro), '') = 'SETTLED' THEN arg_min(rt, ro) WHEN bool_or(coalesce(os, '') = 'SETTLED') THEN any_value(ot)
  ELSE arg_min(rt, ro) FILTER (rs = 'SETTLED') END AS reference_id FROM pairs GROUP BY ALL""",
    "groups": "SELECT * FROM (SELECT * FROM shared UNION ALL SELECT * FROM linked) WHERE member_count >= 2 AND settled_count >= 2",
    "batches": """SELECT tenant_bank_id, batch_id, arg_min(expected_ts, event_ordinal) AS expected, count(*) AS total,
 count(*) FILTER (NOT file_reached_settlement) AS unsettled FROM ev GROUP BY ALL""",
    "issue": f"""SELECT 'DUPLICATE_PAYMENT|' || tenant_bank_id || '|' || link_key AS issue_id, 'DUPLICATE_PAYMENT' AS issue_type, tenant_bank_id,
  'TRANSACTION' AS reference_type, reference_id, NULL::TIMESTAMP AS window_start, NULL::TIMESTAMP AS window_end, NULL::DOUBLE AS severity_score, NULL::BIGINT AS days_overdue FROM groups
 UNION ALL SELECT 'FORMAT_REJECTION|' || tenant_bank_id || '|' || rail_type || '|' || transaction_id, 'FORMAT_REJECTION', tenant_bank_id, 'TRANSACTION', transaction_id, NULL, NULL, NULL, NULL
  FROM ev WHERE format_validation_status = 'FAILED'
 UNION ALL SELECT 'FORMAT_REJECTION_SPIKE|' || tenant_bank_id || '|' || party_id || '|' || {_ISO.format('window_start')}, 'FORMAT_REJECTION_SPIKE', tenant_bank_id, 'PARTY', party_id,
  window_start, window_end, {_drift('zf')}, NULL FROM snap WHERE window_type = 'WEEKLY' AND {_drift('zf')} >= 60
 UNION ALL SELECT 'BATCH_NOT_SETTLED|' || tenant_bank_id || '|' || batch_id, 'BATCH_NOT_SETTLED', tenant_bank_id, 'BATCH', batch_id, NULL, NULL, NULL,
  floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(expected)) / 86400000000)::BIGINT FROM batches WHERE expected <= TIMESTAMP '2024-01-20' AND unsettled > 0
 UNION ALL SELECT 'NETWORK_TIMEOUT_SPIKE|' || tenant_bank_id || '|' || party_id || '|' || {_ISO.format('window_start')}, 'NETWORK_TIMEOUT_SPIKE', tenant_bank_id, 'PARTY', party_id,
  window_start, window_end, least(100.0, abs(zt) * 20), NULL FROM snap WHERE window_type = 'WEEKLY' AND abs(zt) >= 2""",
    "refs": """SELECT tenant_bank_id, 'TRANSACTION' AS reference_type, transaction_id AS reference_id, min(ots) AS first_ts, any_value(rail_type) AS first_rail,
  any_value(amount) AS first_amount, sum(abs(amount)) AS total_amount, count(*) AS event_count FROM ev GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, 'BATCH', batch_id, arg_min(ots, event_ordinal), arg_min(rail_type, event_ordinal), arg_min(amount, event_ordinal), sum(abs(amount)), count(*) FROM ev GROUP BY ALL""",
    "found": """SELECT i.*, first_ts, first_rail, first_amount, total_amount, event_count, coalesce(window_end, first_ts) AS occurred_ts
 FROM issue i LEFT JOIN refs USING (tenant_bank_id, reference_type, reference_id)""",
    "sized": """SELECT *, CASE WHEN issue_type IN ('DUPLICATE_PAYMENT', 'FORMAT_REJECTION') THEN abs(first_amount) WHEN issue_type = 'BATCH_NOT_SETTLED' THEN days_overdue::DOUBLE END AS size FROM found""",
    "ranked0": """SELECT s.*, CASE WHEN issue_type LIKE '%SPIKE' THEN severity_score WHEN size IS NULL THEN 50.0
 ELSE cume_dist() OVER (PARTITION BY tenant_bank_id, issue_type, size IS NULL ORDER BY size) * 100.0 END AS score FROM sized s""",
    "ranked": f"SELECT *, round_even(score, 1) AS priority_score, {_LEVEL.format('score')} AS priority_level FROM ranked0",
    "brk": """SELECT tenant_bank_id || '|' || rail_type || '|' || transaction_id AS break_id, tenant_bank_id, transaction_id, rail_type,
 CASE WHEN reconciliation_status = 'BREAK' THEN 'CONFIRMED_BREAK' ELSE 'PROVISIONAL_VARIANCE' END AS detection_type,
 reconciliation_status AS source_reconciliation_status, reconciliation_variance_amount AS variance_amount, amount, ots AS occurred_ts, party_id
 FROM ev WHERE reconciliation_status = 'BREAK' OR (reconciliation_status IS NOT NULL AND reconciliation_variance_amount <> 0)""",
    "rbrk0": """SELECT *, greatest(cume_dist() OVER (PARTITION BY tenant_bank_id ORDER BY abs(CASE WHEN variance_amount <> 0 THEN variance_amount ELSE amount END)) * 100.0,
 CASE WHEN detection_type = 'CONFIRMED_BREAK' THEN 50.0 ELSE 0.0 END) AS score FROM brk""",
    "rbrk": f"SELECT *, round_even(score, 1) AS priority_score, {_LEVEL.format('score')} AS priority_level FROM rbrk0",
    "claim_ids": """SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_id AS reference_id, occurred_ts FROM found
 UNION ALL SELECT 'reconciliation_break', tenant_bank_id, break_id, occurred_ts FROM brk
 UNION ALL SELECT 'fraud_anomaly', tenant_bank_id, snapshot_id, window_end FROM flagged
 UNION ALL SELECT 'funnel_account', tenant_bank_id, snapshot_id, window_end FROM ben WHERE funnel_drift_score >= 50""",
    "reviews": f"""SELECT signal_type, tenant_bank_id, reference_id, CASE WHEN {_DIGIT.format('reference_id', 1)} % 3 = 0 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS status,
 TIMESTAMP '2024-02-01' + to_seconds(({_DIGIT.format('reference_id', 2)} % 10) * 86400 + {_DIGIT.format('reference_id', 3)} * 60 + {_DIGIT.format('reference_id', 4)}) AS reviewed_at
 FROM claim_ids WHERE {_DIGIT.format('reference_id', 1)} % 3 < 2""",
    "judged": "SELECT c.*, r.status, r.reviewed_at FROM claim_ids c LEFT JOIN reviews r USING (signal_type, tenant_bank_id, reference_id)",
    "claim": """SELECT 'fraud_anomaly' AS signal_type, tenant_bank_id, snapshot_id AS reference_id, coalesce(amount_total, 0.0) AS amount, NULL::VARCHAR AS rail_type, window_end AS occurred_ts FROM flagged
 UNION ALL SELECT 'reconciliation_break', tenant_bank_id, break_id, abs(amount), rail_type, occurred_ts FROM brk
 UNION ALL SELECT 'operational_issue', tenant_bank_id, issue_id, coalesce(total_amount, 0.0), first_rail, first_ts FROM found WHERE issue_type NOT LIKE '%SPIKE'""",
    "reviewed_claim": """SELECT c.*, coalesce(r.status IN ('CONFIRMED', 'DISMISSED'), false) AS done FROM claim c LEFT JOIN reviews r USING (signal_type, tenant_bank_id, reference_id)""",
    "tenants": "SELECT DISTINCT tenant_bank_id FROM ev",
    "domains": "SELECT * FROM tenants, (VALUES ('fraud_anomaly', 'Fraud / Anomaly'), ('reconciliation_break', 'Reconciliation'), ('operational_issue', 'Operational Issues')) d(signal_type, label)",
    "signal": f"""SELECT tenant_bank_id, issue_type AS category, first_rail AS payment_rail, TIMESTAMP '2024-02-01' AS detected_at, 'OPERATIONAL_ISSUE' AS source_type, issue_id AS source_id,
  CASE WHEN reference_type = 'TRANSACTION' THEN reference_id END AS transaction_id, {_LABEL.format('issue_type')} AS anomaly_type, NULL::DOUBLE AS exposure, priority_score AS severity_score, priority_level,
  CASE WHEN reference_type = 'PARTY' THEN reference_id END AS party_id, occurred_ts, first_ts AS event_ts FROM ranked
 UNION ALL SELECT tenant_bank_id, detection_type, rail_type, TIMESTAMP '2024-02-01', 'RECONCILIATION_BREAK', break_id, transaction_id, {_LABEL.format('detection_type')}, abs(coalesce(variance_amount, amount)), priority_score, priority_level, NULL, occurred_ts, occurred_ts FROM rbrk
 UNION ALL SELECT tenant_bank_id, 'FRAUD_' || upper(anomaly_band), CASE WHEN rails_used NOT LIKE '%,%' THEN rails_used END, window_end, 'ANOMALY_SNAPSHOT', snapshot_id, NULL, anomaly_band || ' anomaly', amount_total,
  CASE WHEN anomaly_band = 'Critical' THEN 90.0 ELSE 70.0 END, anomaly_band, party_id, window_end, window_end FROM flagged""",
    "gaps": """SELECT *, CASE WHEN detected_at - lag(detected_at) OVER t <= INTERVAL 48 HOUR THEN 0 ELSE 1 END AS opens FROM signal
 WINDOW t AS (PARTITION BY tenant_bank_id, category, payment_rail ORDER BY detected_at, source_id)""",
    "numbered": """SELECT *, sum(opens) OVER (PARTITION BY tenant_bank_id, category, payment_rail ORDER BY detected_at, source_id ROWS UNBOUNDED PRECEDING) AS number FROM gaps""",
    "opened": "SELECT *, min(detected_at) OVER (PARTITION BY tenant_bank_id, category, payment_rail, number) AS opened_at FROM numbered",
    "alert": """SELECT *, 'CNO-' || upper(substr(sha256(concat_ws('|', tenant_bank_id, category, coalesce(payment_rail, ''), epoch_us(opened_at)::VARCHAR)), 1, 12)) AS case_code FROM opened""",
    "case0": """SELECT tenant_bank_id, case_code, category, payment_rail, opened_at, sum(exposure) AS current_exposure, count(DISTINCT transaction_id) AS txns,
 count(DISTINCT party_id) AS parties, count(*) AS contributing_alerts_count,
 arg_max(struct_pack(s := severity_score, p := priority_level, i := source_id, a := anomaly_type), (severity_score, -epoch_us(detected_at), source_id)) AS worst,
 coalesce(min(CASE WHEN source_type = 'ANOMALY_SNAPSHOT' THEN detected_at WHEN transaction_id IS NOT NULL THEN event_ts END), opened_at) AS anchor_ts FROM alert
 GROUP BY tenant_bank_id, case_code, category, payment_rail, opened_at""",
    "kase": f"""SELECT *, CASE WHEN txns > 0 THEN txns ELSE greatest(parties, contributing_alerts_count) END AS transactions_affected, worst.s AS severity_score,
 worst.p AS priority_level, worst.i AS worst_source_id, concat_ws(' ', payment_rail, {_LABEL.format('category')}, 'Cluster') AS title FROM case0""",
    "anchor": """SELECT tenant_bank_id, issue_type AS category, first_rail AS payment_rail, CASE WHEN issue_type LIKE '%SPIKE' THEN window_end ELSE first_ts END AS ts FROM found
 UNION ALL SELECT tenant_bank_id, detection_type, rail_type, occurred_ts FROM brk
 UNION ALL SELECT tenant_bank_id, 'FRAUD_' || upper(anomaly_band), CASE WHEN rails_used NOT LIKE '%,%' THEN rails_used END, window_end FROM flagged""",
    "weekly": """SELECT tenant_bank_id, category, payment_rail, date_trunc('week', ts)::TIMESTAMP AS week_start, count(*) AS "count" FROM anchor WHERE payment_rail IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, category, NULL, date_trunc('week', ts)::TIMESTAMP, count(*) FROM anchor WHERE ts IS NOT NULL GROUP BY ALL""",
    "trend0": """SELECT tenant_bank_id, category, payment_rail, count(*) AS weeks_observed, arg_max("count", week_start) AS latest_week_count, max(week_start) AS latest_week,
 (sum("count") - arg_max("count", week_start)) / (count(*) - 1) AS prior_mean FROM weekly GROUP BY ALL HAVING count(*) >= 2""",
    "trend": """SELECT *, round_even(prior_mean, 1) AS prior_weeks_average_count, CASE WHEN latest_week_count > prior_mean * 1.2::DOUBLE THEN 'increasing'
 WHEN latest_week_count < prior_mean * 0.8::DOUBLE THEN 'decreasing' ELSE 'stable' END AS direction FROM trend0""",
}


def statement(body: str, **replaced: str) -> str:
    """A whole statement from a final select over the shared definitions, some of them replaced.

    A body that starts with a comma adds definitions of its own first.
    """
    definitions = ",\n".join(f"{name} AS ({select})" for name, select in {**CTES, **replaced}.items())
    return f"WITH {definitions}\n{body}"
