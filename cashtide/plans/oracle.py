"""DuckDB SQL of the engine's queries, written apart from the operators: joins and windows in their plainest form."""

from __future__ import annotations

from ..functions import text

_STOP = ", ".join(f"'{w}'" for w in text.STOP_TOKENS)


def _category(c: str) -> str:
    arms = "\n".join(
        "WHEN " + " OR ".join("contains({}, '{}')".format(c, n.replace("'", "''")) for n in needles) + f" THEN '{name}'" for name, needles in text.CATEGORY_RULES
    )
    return f"CASE {arms} ELSE 'Other' END"


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+')))"


BASE = f"""
acc AS (SELECT c_custkey AS account_id, c_name AS name, n_name AS org, c_acctbal::DECIMAL(18,2) AS balance,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'checking' WHEN 'FURNITURE' THEN 'savings' WHEN 'MACHINERY' THEN 'card' WHEN 'AUTOMOBILE' THEN 'loan' ELSE 'other' END AS kind
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
snap AS (SELECT event_id AS id, user_id AS account_id, ts AS recorded_at, (CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * value::DECIMAL(18,2))::DECIMAL(18,2) AS balance,
  CASE WHEN event_type = 'signup' THEN 'manual' ELSE 'feed' END AS source FROM events),
txn AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, o_custkey AS account_id, l_shipdate::DATE AS posted,
  (CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 2))::DECIMAL(18,2) AS amount,
  p_brand AS payee, p_name AS description, l_linestatus = 'O' AS pending FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
inst AS (SELECT o_orderkey AS id, o_custkey AS entity_id, concat_ws(':', o_custkey, o_orderpriority) AS obligation_id, 'Brand ' || o_orderpriority AS name, o_orderdate::DATE AS due_date,
  o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderpriority = '5-LOW' THEN 'inflow' ELSE 'outflow' END AS direction,
  CASE o_orderstatus WHEN 'O' THEN 'expected' WHEN 'P' THEN 'partially_paid' ELSE 'paid' END AS status, o_orderpriority = '3-MEDIUM' AS discretionary,
  round(o_totalprice::DECIMAL(18,2) * 0.25::DECIMAL(3,2), 2)::DECIMAL(18,2) AS required_minimum, o_orderpriority IN ('1-URGENT', '2-HIGH') AS estimated,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'very_low' WHEN '2-HIGH' THEN 'low' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'high' END AS confidence FROM orders),
spend AS (SELECT *, {_category("lower(coalesce(payee, '') || ' ' || coalesce(description, ''))")} AS category,
  trim(regexp_replace(payee, '#?[0-9]{{2,}}', '', 'g'), ' -*#') AS merchant, strftime(posted, '%Y-%m') AS month, -amount AS spend FROM txn WHERE amount < 0),
ev AS (SELECT *, CASE direction WHEN 'inflow' THEN amount ELSE -amount END AS signed, row_number() OVER (PARTITION BY entity_id ORDER BY due_date, id) AS seq
  FROM inst WHERE status <> 'paid' AND due_date >= DATE '1998-01-01' AND due_date < DATE '1998-01-01' + 365),
run AS (SELECT e.*, a.balance + sum(signed) OVER (PARTITION BY entity_id ORDER BY seq) AS balance FROM ev e JOIN acc a ON entity_id = account_id),
tro AS (SELECT account_id AS entity_id, a.balance AS starting, coalesce(m.ending, a.balance) AS ending, CASE WHEN m.low < a.balance THEN m.low ELSE a.balance END AS low,
  CASE WHEN m.low < a.balance THEN m.low_date ELSE DATE '1998-01-01' END AS low_date, coalesce(m.n, 0) AS n_events
  FROM acc a LEFT JOIN (SELECT entity_id, arg_max(balance, seq) AS ending, min(balance) AS low, arg_min(due_date, (balance, seq)) AS low_date, count(*) AS n FROM run GROUP BY entity_id) m ON account_id = entity_id),
words_i AS (SELECT *, {_tokens("name")} AS words FROM inst),
words_t AS (SELECT *, {_tokens("payee || ' ' || description")} AS said, abs(amount) AS observed, CASE WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS direction FROM txn),
near AS (SELECT i.id AS instance_id, t.id AS transaction_id, i.due_date, i.direction, i.amount AS expected, t.observed, (t.posted - i.due_date)::BIGINT AS days, abs(t.observed - i.amount) AS delta,
  round(CASE WHEN len(words) = 0 OR len(said) = 0 THEN 0.0 ELSE len(list_intersect(words, said))::DOUBLE / len(list_distinct(list_concat(words, said))) END, 3) AS merchant_score
  FROM words_i i JOIN words_t t ON i.entity_id = t.account_id AND i.direction = t.direction AND t.posted BETWEEN i.due_date - 3 AND i.due_date + 3),
scored AS (SELECT *, CASE WHEN delta <= 0.005 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS amount_score,
  CASE WHEN abs(days) <= 1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(days) - 1) / 3.0::DOUBLE) END AS date_score FROM near),
rated AS (SELECT *, round(0.5::DOUBLE * amount_score + 0.3::DOUBLE * date_score + 0.2::DOUBLE * merchant_score, 3) AS base, delta < 0.005 AND abs(days) <= 2 AS sure FROM scored),
typed AS (SELECT *, CASE WHEN sure THEN greatest(base, 0.9::DOUBLE) ELSE base END AS score, CASE WHEN sure THEN 'auto' WHEN merchant_score = 0 AND delta >= 0.005 THEN 'below_threshold'
  WHEN base >= 0.85 THEN 'auto' WHEN base >= 0.55 THEN 'needs_review' ELSE 'below_threshold' END AS match_type FROM rated),
pairs AS (SELECT * FROM typed WHERE delta <= greatest(50000.00, expected * 0.5)),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, abs(days), delta, transaction_id) = 1),
match AS (SELECT * FROM best WHERE match_type <> 'below_threshold'),
drift AS (SELECT i.id, i.entity_id, (DATE '1998-06-30' - i.due_date)::BIGINT AS age_days, i.amount, i.direction, s.top,
  s.top.merchant_score > 0 AND abs(s.top.days) <= 3 AS same FROM inst i LEFT JOIN (
    SELECT instance_id, bool_or(match_type = 'auto' AND delta <= greatest(50000.00, expected * 0.5)) AS clean,
      arg_min({{'merchant_score': merchant_score, 'days': days, 'observed': observed}}, (-score, abs(days), delta, transaction_id)) AS top
    FROM typed WHERE delta <= greatest(50000.00, expected * 0.9) GROUP BY instance_id) s ON s.instance_id = i.id
  WHERE i.status <> 'paid' AND i.due_date < DATE '1998-06-30' AND NOT coalesce(s.clean, false)),
found AS (SELECT *, CASE WHEN coalesce(same, false) AND abs(top.observed - amount) > amount * 0.2 THEN 'amount_changed' WHEN NOT coalesce(same, false) AND age_days > 7 THEN 'missing_expected' END AS finding_type FROM drift),
drifts AS (SELECT id, entity_id, finding_type, CASE WHEN finding_type = 'amount_changed' THEN 'medium' WHEN age_days > 30 THEN 'critical' ELSE 'high' END AS severity,
  (CASE WHEN finding_type = 'amount_changed' THEN (top.observed - amount) * CASE direction WHEN 'inflow' THEN 1 ELSE -1 END ELSE amount * CASE direction WHEN 'inflow' THEN -1 ELSE 1 END END)::DOUBLE AS impact, age_days
  FROM found WHERE finding_type IS NOT NULL),
rows AS (SELECT t.account_id, id, posted, kind AS class, abs(amount) AS paid, trim(regexp_replace(lower(payee), '[^a-z0-9]+', '_', 'g'), '_') AS merchant_key
  FROM txn t JOIN acc a ON t.account_id = a.account_id WHERE amount < 0),
gapped AS (SELECT *, posted - lag(posted) OVER (PARTITION BY account_id, merchant_key, class ORDER BY posted, id) AS gap FROM rows),
stats AS (SELECT account_id, merchant_key, class, count(*) AS n, avg(paid::DOUBLE) AS mean, median(paid::DOUBLE) AS median_amount, min(paid) AS low, max(paid) AS high,
  stddev_pop(paid::DOUBLE) / avg(paid::DOUBLE) AS cv, median(gap)::DOUBLE AS median_gap, list(gap) FILTER (gap IS NOT NULL) AS gaps, list(paid ORDER BY posted DESC, id DESC)[1:3] AS recent,
  max(posted) AS last_date, (round_even((max(posted) - min(posted)) / 30.44::DOUBLE, 0) + 1)::BIGINT AS months_covered, date_diff('month', min(posted), max(posted)) + 1 AS span_months
  FROM gapped GROUP BY ALL HAVING count(*) >= 2),
label AS (SELECT *, CASE WHEN median_gap IS NULL OR median_gap < 4 THEN ['unknown', '-1', '3'] WHEN median_gap <= 10 THEN ['weekly', '4', '10'] WHEN median_gap <= 18 THEN ['biweekly', '10', '18']
  WHEN median_gap <= 37 THEN ['monthly', '18', '37'] WHEN median_gap <= 75 THEN ['irregular_multiweek', '', ''] WHEN median_gap <= 100 THEN ['quarterly', '75', '100'] ELSE ['irregular', '', ''] END AS l FROM stats),
cad AS (SELECT *, CASE WHEN l[1] IN ('irregular', 'irregular_multiweek') THEN l[1]
  WHEN len(list_filter(gaps, lambda g: CASE l[1] WHEN 'unknown' THEN g < 4 WHEN 'weekly' THEN g >= 4 AND g <= 10 ELSE g > l[2]::INT AND g <= l[3]::INT END)) >= 3 THEN l[1] ELSE 'unknown' END AS cadence,
  CASE WHEN len(recent) >= 2 AND list_max(recent) - list_min(recent) <= greatest(0.01, list_max(recent)::DOUBLE * 0.01) THEN 'fixed_last' WHEN cv <= 0.05 THEN 'fixed' WHEN cv <= 0.20 THEN 'average' ELSE 'needs_review' END AS method FROM label),
cand AS (SELECT *, CASE method WHEN 'fixed_last' THEN recent[1]::DOUBLE WHEN 'needs_review' THEN median_amount ELSE mean END AS amount,
  CASE WHEN n >= 4 AND months_covered >= 4 AND cadence IN ('weekly', 'biweekly', 'monthly') AND cv <= 0.10 THEN 'high'
    WHEN n >= 3 AND months_covered >= 3 AND cadence IN ('weekly', 'biweekly', 'monthly', 'irregular_multiweek') THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN method = 'needs_review' THEN 'variable_spend' WHEN class = 'card' THEN 'card_statement_input' WHEN class IN ('checking', 'savings') THEN 'direct_checking_outflow' ELSE 'review_only' END AS candidate_type FROM cad),
prio AS (SELECT *, amount * n / greatest(span_months, 1) * CASE candidate_type WHEN 'variable_spend' THEN 0.3::DOUBLE WHEN 'card_statement_input' THEN 0.9::DOUBLE WHEN 'direct_checking_outflow' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS priority,
  cadence IN ('weekly', 'biweekly', 'monthly', 'quarterly') AS regular FROM cand),
hol AS (
  SELECT CASE dayofweek(h) WHEN 6 THEN h - 1 WHEN 0 THEN h + 1 ELSE h END AS day FROM (SELECT make_date(y::INT, m, d) AS h FROM range(2025, 2030) t(y), (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) v(m, d))
  UNION SELECT f + ((w - dayofweek(f) + 7) % 7 + 7 * (n - 1))::INT FROM (SELECT make_date(y::INT, m, 1) AS f, w, n FROM range(2025, 2030) t(y), (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, w, n))
  UNION SELECT l - ((dayofweek(l) + 6) % 7)::INT FROM (SELECT make_date(y::INT, 5, 31) AS l FROM range(2025, 2030) t(y))),
cal AS (SELECT d::DATE AS day, dayofweek(d) NOT IN (0, 6) AND d::DATE NOT IN (SELECT day FROM hol) AS is_business FROM generate_series(DATE '2025-12-15', DATE '2027-12-31', INTERVAL 1 DAY) t(d)),
bus AS (SELECT c.day, c.is_business, (SELECT max(b.day) FROM cal b WHERE b.is_business AND b.day <= c.day) AS previous_business FROM cal c)"""

YEAR = "posted BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND category NOT IN ('Transfers', 'Income')"
_LATEST = "SELECT account_id, id, balance::DOUBLE AS balance, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, source FROM snap {} QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source = 'manual' DESC, recorded_at DESC, id DESC) = 1"
_AS_OF = "WHERE recorded_at::DATE <= DATE '%s'"
_BAND = """SELECT t.entity_id, t.low, coalesce(sum(d), 0) AS downside, t.low - coalesce(sum(d), 0) < 2500 AS breach FROM tro t LEFT JOIN (
  SELECT entity_id, due_date, round(amount * CASE confidence WHEN 'low' THEN 0.20 ELSE 0.35 END, 2)::DECIMAL(18,2) AS d FROM ev WHERE direction = 'outflow' AND estimated) e
  ON e.entity_id = t.entity_id AND e.due_date <= t.low_date GROUP BY t.entity_id, t.low"""

_ESTIMATED = """SELECT obligation_id, entity_id AS account_id, median(amount::DOUBLE) AS amount, CASE any_value(confidence) WHEN 'very_low' THEN 4.345::DOUBLE ELSE 2.173::DOUBLE END AS factor,
  'brand_' || (entity_id % 5 + 1) || (entity_id // 5 % 5 + 1) AS merchant_key FROM inst WHERE status <> 'paid' GROUP BY ALL HAVING bool_and(estimated AND direction = 'outflow')"""


def _contradicted(floor: int, ratio: int, flat_ratio: str) -> str:
    held = " AND ".join(f"modeled >= greatest({floor}::DOUBLE, {c} * ratio)" for c in ("observed", "m0", "m1"))
    return f"""SELECT obligation_id, modeled, observed, CASE WHEN observed <= 5 THEN 'dormant' ELSE 'rewrite' END AS resolution, CASE WHEN observed > 5 THEN round((observed / factor)::DECIMAL(20,6), 2)::DOUBLE END AS new_amount FROM (
  SELECT e.*, round((amount * factor)::DECIMAL(20,6), 2)::DOUBLE AS modeled, round((coalesce(total, 0) / 9.0::DOUBLE)::DECIMAL(20,6), 2)::DOUBLE AS observed, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1,
    CASE WHEN account_id IN (SELECT f.account_id FROM (SELECT account_id, abs(balance) AS b FROM snap WHERE recorded_at::DATE - 9497 >= DATE '1998-01-10' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY recorded_at, id) = 1) f
      JOIN (SELECT account_id, abs(balance) AS b FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY recorded_at DESC, id DESC) = 1) l ON l.account_id = f.account_id AND l.b <= f.b) THEN {flat_ratio}::DOUBLE ELSE {ratio}::DOUBLE END AS ratio FROM ({_ESTIMATED}) e LEFT JOIN (
    SELECT account_id, trim(regexp_replace(lower(payee), '[^a-z0-9]+', '_', 'g'), '_') AS merchant_key, sum(-amount)::DOUBLE AS total, sum(-amount) FILTER (DATE '1998-06-30' - posted < 30)::DOUBLE AS m0,
      sum(-amount) FILTER (DATE '1998-06-30' - posted BETWEEN 30 AND 59)::DOUBLE AS m1 FROM txn WHERE amount < 0 AND posted BETWEEN DATE '1998-06-30' - 270 AND DATE '1998-06-30' GROUP BY ALL) s USING (account_id, merchant_key)
  WHERE account_id IN (SELECT account_id FROM txn WHERE posted BETWEEN DATE '1998-06-30' - 270 AND DATE '1998-06-30'))
  WHERE {held}"""


BODY = {
    "income_biweekly": "SELECT DISTINCT previous_business::VARCHAR AS pay_date FROM bus WHERE day BETWEEN DATE '2026-01-02' AND DATE '2026-12-31' AND (day - DATE '2026-01-02') % 14 = 0 AND previous_business >= DATE '2026-01-01'",
    "working_account": "SELECT org, account_id, name FROM acc QUALIFY row_number() OVER (PARTITION BY org ORDER BY CASE WHEN contains(lower(name), '0000007') THEN 1 WHEN kind = 'checking' THEN 2 ELSE 3 END, account_id) = 1",
    "guardrail_drift_sum": "SELECT entity_id, sum(abs(impact::DECIMAL(18,2)))::DOUBLE AS total, count(*) AS n FROM drifts GROUP BY 1 HAVING total > 200",
    "check_suggestions": """SELECT substr(sha256(i || chr(0) || t), 1, 24) AS suggestion_id, i AS instance_id, t AS transaction_id, round(0.9::DOUBLE * b + 0.1::DOUBLE / count(*) OVER (PARTITION BY t), 3) AS score, count(*) OVER (PARTITION BY t) > 1 AS ambiguous FROM (
  SELECT i.id AS i, t.id AS t, round(0.5::DOUBLE * (1 - delta::DOUBLE / tol::DOUBLE) + 0.3::DOUBLE * (1 - abs(t.posted - i.due_date) / 7.0::DOUBLE) + h + h, 3) AS b
  FROM (SELECT *, greatest(50000.00, amount * 0.5) AS tol, CASE WHEN obligation_id IN (SELECT obligation_id FROM inst WHERE status = 'paid') THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS h FROM inst) i
  JOIN txn t ON t.account_id = i.entity_id AND t.posted BETWEEN i.due_date - 7 AND i.due_date + 7, LATERAL (SELECT abs(-t.amount - i.amount) AS delta) x
  WHERE i.direction = 'outflow' AND i.status = 'expected' AND i.due_date <= DATE '2000-12-31' AND t.amount < 0 AND NOT t.pending AND delta <= tol
    AND t.account_id IN (SELECT account_id FROM acc WHERE kind = 'checking') AND i.id NOT IN (SELECT instance_id FROM match) AND t.id NOT IN (SELECT transaction_id FROM match))""",
    "dormant_accounts": f"SELECT obligation_id, account_id FROM ({_ESTIMATED}) e WHERE account_id % 3 = 0 AND account_id NOT IN (SELECT account_id FROM txn WHERE posted BETWEEN DATE '1998-06-30' - 60 AND DATE '1998-06-30')",
    "contradicted_estimates": _contradicted(500000, 2, "1.5"),
    "contradicted_by_balance": _contradicted(100000, 48, "12"),
    "estimates_resolved": f"""SELECT id, CASE action WHEN 'rewrite' THEN new_amount ELSE amount END::DOUBLE AS amount, CASE WHEN action = 'rewrite' OR id % 4 = 0 THEN 'estimate_contradicted' WHEN id % 4 = 1 THEN 'average' END AS amount_source,
  CASE action WHEN 'rewrite' THEN amount END::DOUBLE AS previous_amount, action FROM (SELECT i.*, new_amount, CASE WHEN resolution IS NOT NULL AND estimated AND status <> 'paid' AND id % 4 <> 0 THEN resolution ELSE 'kept' END AS action
  FROM inst i LEFT JOIN ({_contradicted(100000, 48, "12")}) c USING (obligation_id))""",
    "estimate_provenance": """SELECT id, coalesce(len(m), 0) AS n_covered, len(miss) AS n_missing, list_min(miss)::VARCHAR AS first_missing, coalesce(len(miss) = 0, false) AS complete FROM (
  SELECT id, m, CASE WHEN m IS NOT NULL THEN list_filter(list_transform(range(0, date_diff('month', list_min(m), due_date) + 1), lambda k: (list_min(m) + to_months(k::INT))::DATE), lambda x: NOT list_contains(m, x))[1:60] END AS miss
  FROM (SELECT *, 'brand_' || (entity_id % 5 + 1) || (entity_id // 5 % 5 + 1) AS merchant_key FROM inst) i LEFT JOIN (
    SELECT account_id, trim(regexp_replace(lower(payee), '[^a-z0-9]+', '_', 'g'), '_') AS merchant_key, list(DISTINCT date_trunc('month', posted)::DATE) AS m FROM txn GROUP BY ALL) e ON e.account_id = i.entity_id AND e.merchant_key = i.merchant_key
  WHERE estimated AND status <> 'paid')""",
    "note_contradictions": r"""SELECT id, field, note_says, record_says FROM (
  WITH n AS (SELECT id, status, estimated, CASE confidence WHEN 'very_low' THEN 'weekly' WHEN 'low' THEN 'biweekly' WHEN 'high' THEN 'quarterly' ELSE 'monthly' END AS cadence,
    ['quarterly now', 'account closed', 'placeholder, was weekly or bi-weekly', 'no longer active', 'annually; estimate', ''][id % 6 + 1] AS note FROM inst)
  SELECT DISTINCT id, 'cadence' AS field, canon AS note_says, cadence AS record_says FROM n JOIN (VALUES ('weekly', 'weekly'), ('bi-weekly', 'biweekly'), ('monthly', 'monthly'), ('quarterly', 'quarterly'), ('annually', 'annual')) v(word, canon)
    ON regexp_matches(note, '(^|\W)' || word || '(\W|$)') AND canon <> cadence
  UNION ALL SELECT id, 'status', CASE WHEN contains(note, 'closed') THEN 'closed' ELSE 'no longer active' END, status FROM n WHERE status <> 'paid' AND (contains(note, 'closed') OR contains(note, 'no longer'))
  UNION ALL SELECT id, 'amount_status', CASE WHEN contains(note, 'estimate') THEN 'estimate' ELSE 'placeholder' END, 'confirmed' FROM n WHERE NOT estimated AND (contains(note, 'estimate') OR contains(note, 'placeholder')))""",
    "backfill_dates": """SELECT obligation_id, back::VARCHAR AS due_date, amount::DOUBLE AS amount FROM (
  SELECT obligation_id, amount, unnest(list_transform(range(1, 700), lambda k: CASE confidence WHEN 'very_low' THEN due_date - (7 * k)::INT WHEN 'low' THEN due_date - (14 * k)::INT ELSE (due_date - to_months(k::INT))::DATE END)) AS back
  FROM inst WHERE direction = 'outflow' AND confidence <> 'high' QUALIFY row_number() OVER (PARTITION BY obligation_id ORDER BY due_date, id) = 1) WHERE back >= DATE '1997-06-30' - 600 AND back < DATE '1997-06-30'""",
    "unexpected_recurring": """SELECT account_id, merchant_key, round(priority, 6) AS impact, round(priority / CASE candidate_type WHEN 'variable_spend' THEN 0.3::DOUBLE WHEN 'card_statement_input' THEN 0.9::DOUBLE WHEN 'direct_checking_outflow' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END, 6) AS monthly
  FROM prio WHERE NOT (months_covered < 2 AND NOT regular) AND candidate_type NOT IN ('review_only') AND NOT (candidate_type = 'variable_spend' AND (regular OR confidence = 'low'))
    AND account_id NOT IN (SELECT entity_id FROM inst WHERE status <> 'paid' AND confidence = 'high')""",
    "verify_statement_identity": """SELECT cycle_id, (s + 1)::DOUBLE AS input_sum, s::DOUBLE AS recomputed FROM (
  SELECT s.id AS cycle_id, coalesce(sum(i.amount), 0) AS s FROM (SELECT *, coalesce(lag(due_date) OVER w, DATE '1900-01-01') AS before, lead(due_date) OVER w AS after, lag(id) OVER w AS prev FROM inst WHERE confidence = 'very_low' WINDOW w AS (PARTITION BY entity_id ORDER BY due_date, id)) s
  LEFT JOIN inst i ON i.entity_id = s.entity_id AND i.direction = 'outflow' AND i.confidence <> 'very_low' AND i.due_date > s.before AND i.due_date <= s.due_date GROUP BY 1) WHERE cycle_id % 7 = 0""",
    "verify_projection_identity": "SELECT t.entity_id, t.ending::DOUBLE AS ending, (t.starting + coalesce(m, 0))::DOUBLE AS recomputed, abs(t.ending - t.starting - coalesce(m, 0)) <= 0.01 AS holds FROM tro t LEFT JOIN (SELECT entity_id, sum(signed) AS m FROM ev GROUP BY 1) e ON e.entity_id = t.entity_id",
    "verify_overlap": """SELECT a.obligation_id AS obligation_a, b.obligation_id AS obligation_b, len(list_intersect(a.months, b.months)) AS n_months, a.g = b.g AS exact FROM ob a JOIN ob b
  ON a.entity_id = b.entity_id AND a.direction = b.direction AND a.obligation_id < b.obligation_id AND len(list_intersect(a.months, b.months)) > 0 AND (a.g = b.g OR abs(a.mid - b.mid) <= greatest(a.mid, b.mid) * 0.15::DOUBLE)""",
    "grounding_checks": """SELECT CASE WHEN account_id % 7 = 0 THEN -account_id - 1 ELSE account_id END AS key, (balance + CASE WHEN account_id % 5 = 0 THEN 0.02 ELSE 0.01 END)::DOUBLE AS claimed, CASE WHEN account_id % 7 <> 0 THEN balance::DOUBLE END AS found,
  CASE WHEN account_id % 7 = 0 THEN 'unsupported' WHEN account_id % 5 = 0 THEN 'mismatch' ELSE 'grounded' END AS verdict FROM acc""",
    "grounding_counts": "SELECT entity_id, direction, sum(c)::BIGINT AS n_claimed, sum(f)::BIGINT AS n_found FROM (SELECT entity_id, CASE WHEN id % 9 = 0 THEN 'unknown' ELSE direction END AS direction, 1 AS c, 0 AS f FROM inst UNION ALL SELECT entity_id, CASE WHEN id % 8 = 0 THEN 'unknown' ELSE direction END, 0, 1 FROM inst) GROUP BY ALL HAVING n_claimed <> n_found",
    "migration_dedup": """SELECT t.id, i.instance_id, CASE WHEN i.instance_id IS NULL THEN 'new' ELSE 'already_modeled' END AS verdict FROM words_t t LEFT JOIN (
  SELECT t.id, arg_min(i.id, (i.due_date, i.id)) AS instance_id FROM words_t t JOIN words_i i ON i.entity_id = t.account_id AND i.direction = t.direction AND i.due_date BETWEEN t.posted - 7 AND t.posted + 7
    AND abs(t.observed - i.amount) <= greatest(5.00, greatest(t.observed, i.amount) * 0.6) AND len(list_intersect(i.words, list_filter(regexp_split_to_array(lower(t.payee), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')))) > 0 GROUP BY 1) i ON i.id = t.id""",
    "spending_by_category": f"SELECT category AS key, sum(spend)::DOUBLE AS total, count(*) AS n FROM spend WHERE {YEAR} GROUP BY 1 ORDER BY total DESC, key LIMIT 10",
    "spending_by_merchant": f"SELECT merchant AS key, sum(spend)::DOUBLE AS total, count(*) AS n FROM spend WHERE {YEAR} GROUP BY 1",
    "spending_by_month": "SELECT month, total::DOUBLE AS total, n, (total - lag(total) OVER (ORDER BY month))::DOUBLE AS change FROM (SELECT month, sum(spend) AS total, count(*) AS n FROM spend WHERE posted BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND category NOT IN ('Transfers', 'Income') GROUP BY 1)",
    "spending_samples": f"SELECT merchant AS key, id, posted::VARCHAR AS posted, row_number() OVER (PARTITION BY merchant ORDER BY posted, id) AS rank FROM spend WHERE {YEAR} QUALIFY rank <= 5",
    "list_transactions": "SELECT t.account_id, id, posted::VARCHAR AS posted, amount::DOUBLE AS amount, payee, description, pending, rank, total > 100 AS truncated, name AS account_name FROM (SELECT *, row_number() OVER (ORDER BY posted DESC, id DESC) AS rank, count(*) OVER () AS total FROM txn WHERE posted BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND contains(lower(payee || ' ' || description), 'widget') AND abs(amount) >= 1000 AND NOT pending) t LEFT JOIN acc a ON a.account_id = t.account_id WHERE rank <= 100",
    "latest_balance": _LATEST.format(""),
    "asof_balance": _LATEST.format("WHERE recorded_at::DATE <= DATE '2024-01-15'"),
    "balance_coverage": f"SELECT count(*) AS n_accounts, count(*) FILTER (l.id IS NULL) AS n_missing, count(*) FILTER (age < 0 OR age > 3) AS n_stale, min(day)::VARCHAR AS oldest, max(day)::VARCHAR AS newest, sum(l.balance) FILTER (l.balance >= 0)::DOUBLE AS liquid, count(*) FILTER (l.id IS NULL) = 0 AND count(*) FILTER (age < 0 OR age > 3) = 0 AS complete FROM acc a LEFT JOIN (SELECT account_id, id, balance::DECIMAL(18,2) AS balance, recorded_at::TIMESTAMP::DATE AS day, DATE '2024-01-31' - recorded_at::TIMESTAMP::DATE AS age FROM ({_LATEST.format('')})) l ON l.account_id = a.account_id",
    "project_running_balance": "SELECT entity_id, id, seq, signed::DOUBLE AS signed, balance::DOUBLE AS balance FROM run",
    "project_trough": "SELECT entity_id, starting::DOUBLE AS starting, ending::DOUBLE AS ending, low::DOUBLE AS low, low_date::VARCHAR AS low_date, n_events FROM tro",
    "project_capped_fold": "SELECT entity_id, starting::DOUBLE AS starting, balance::DOUBLE AS ending, low::DOUBLE AS low, low_date::VARCHAR AS low_date FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1",
    "past_due_carry": "SELECT id, entity_id, due_date::VARCHAR AS due_date, amount::DOUBLE AS amount FROM inst WHERE status <> 'paid' AND due_date < DATE '1998-01-01' AND id NOT IN (SELECT instance_id FROM match)",
    "roll_forward": "SELECT account_id AS entity_id, (a.balance + coalesce(sum(CASE i.direction WHEN 'inflow' THEN amount ELSE -amount END), 0))::DOUBLE AS starting FROM acc a LEFT JOIN inst i ON i.entity_id = account_id AND status <> 'paid' AND due_date > DATE '1997-10-01' AND due_date < DATE '1998-01-01' GROUP BY account_id, a.balance",
    "trough_band": f"SELECT entity_id, low::DOUBLE AS low, downside::DOUBLE AS downside, breach FROM ({_BAND})",
    "recon_candidates": "SELECT instance_id, transaction_id, days, delta::DOUBLE AS delta, amount_score, date_score, merchant_score, score, match_type FROM pairs",
    "recon_best": "SELECT instance_id, transaction_id, score, match_type FROM best",
    "recon_unmatched": "SELECT id, entity_id, due_date::VARCHAR AS due_date, (DATE '1998-06-30' - due_date)::BIGINT AS age_days, DATE '1998-06-30' - due_date > 7 AS past_grace FROM inst WHERE status <> 'paid' AND due_date <= DATE '1998-06-30' AND id NOT IN (SELECT instance_id FROM match)",
    "prior_amount_change": "SELECT instance_id, previous::DOUBLE AS previous, coalesce(abs(amount - previous) > 5 AND abs(amount - previous) > previous * 0.1, false) AS changed FROM (SELECT id AS instance_id, amount, last_value(CASE WHEN NOT discretionary THEN amount END IGNORE NULLS) OVER (PARTITION BY obligation_id ORDER BY due_date, id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS previous FROM inst)",
    "post_cancellation": "SELECT obligation_id, t.id AS transaction_id, t.posted::VARCHAR AS posted, t.observed::DOUBLE AS observed, e.ended::VARCHAR AS cancelled_on FROM (SELECT obligation_id, entity_id, direction, words, max(due_date) AS ended, arg_max(amount, (due_date, id)) AS last_amount FROM words_i GROUP BY ALL) e JOIN words_t t ON t.account_id = e.entity_id AND t.direction = e.direction AND t.posted > e.ended AND abs(t.observed - last_amount) <= greatest(50000.00, last_amount * 0.5) AND len(list_intersect(words, said)) > 0 WHERE t.id NOT IN (SELECT transaction_id FROM match)",
    "recurring_stats": "SELECT account_id, merchant_key, class, n, round(mean, 6) AS mean, round(median_amount, 6) AS median_amount, low::DOUBLE AS low, high::DOUBLE AS high, round(cv, 6) AS cv, median_gap, months_covered, span_months FROM stats",
    "recurring_triage": """SELECT account_id, merchant_key, cadence, method, confidence, candidate_type, round(priority::DECIMAL(28,10), 6)::DOUBLE AS priority, CASE WHEN months_covered < 2 AND NOT regular THEN CASE WHEN priority > 75 THEN 'park' ELSE 'auto_reject' END
  WHEN candidate_type = 'variable_spend' AND NOT regular AND confidence = 'low' THEN CASE WHEN priority > 75 THEN 'park' ELSE 'auto_reject' END WHEN candidate_type = 'variable_spend' AND regular THEN 'park' WHEN candidate_type = 'review_only' THEN 'park' ELSE 'surface' END AS disposition FROM prio""",
    "apply_schedule": """SELECT account_id, merchant_key, unnest(CASE WHEN cadence = 'monthly' THEN list_filter(list_transform(range(0, 8), lambda i: (last_date + to_months(i::INT))::DATE), lambda x: x < last_date + 180)
  ELSE list_transform(range(0, 180, CASE cadence WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'quarterly' THEN 91 ELSE greatest(1, round_even(median_gap, 0))::BIGINT END), lambda i: last_date + i::INT) END)::VARCHAR AS due_date FROM prio WHERE confidence IN ('medium', 'high')""",
    "drift_payment": "SELECT * FROM drifts",
    "stale_estimates": "SELECT id, entity_id, amount::DOUBLE AS amount, (due_date - 30)::VARCHAR AS review_after FROM inst WHERE estimated AND status <> 'paid' AND due_date - 30 <= DATE '1998-06-30'",
    "arrived_deposits": "SELECT id, t.account_id, posted::VARCHAR AS posted, amount::DOUBLE AS amount FROM txn t WHERE amount >= 50 AND NOT pending AND posted BETWEEN DATE '2000-06-30' - 14 AND DATE '2000-06-30' AND account_id IN (SELECT account_id FROM acc WHERE kind = 'checking') AND id NOT IN (SELECT transaction_id FROM match)",
    "guardrail_floor": "SELECT entity_id, low::DOUBLE AS low, 'medium' AS severity FROM tro WHERE low < 2500",
    "debt_avalanche": "SELECT org AS entity_id, account_id AS id, row_number() OVER (PARTITION BY org ORDER BY account_id % 30 DESC, account_id) AS rank, ((2 * (abs(balance) * (account_id % 30 + 5)::DECIMAL(5,2) * 10000)::BIGINT + 120000) // 240000) / 100.0::DOUBLE AS monthly_interest FROM acc WHERE kind = 'card' AND balance <> 0",
    "goal_pace": """SELECT id, CASE WHEN p >= 5000 THEN 'completed' WHEN d IS NULL THEN 'no_deadline' WHEN d - DATE '2024-06-01' BETWEEN 0 AND 14 THEN 'due_soon' WHEN NOT t THEN 'pending'
  WHEN 152.0::DOUBLE / (d - DATE '2024-01-01') < 0.10 AND d >= DATE '2024-06-01' THEN 'on_track' WHEN p::DOUBLE / 5000 >= 152.0::DOUBLE / (d - DATE '2024-01-01') THEN 'on_track' ELSE 'behind' END AS status, greatest(5000 - p, 0)::DOUBLE AS remaining
  FROM (SELECT s_suppkey AS id, s_acctbal::DECIMAL(18,2) AS p, CASE WHEN s_suppkey % 10 <> 0 THEN DATE '2024-05-01' + (s_suppkey * 37 % 400)::INT END AS d, s_nationkey % 2 = 0 AS t FROM supplier)""",
    "statement_cycles": "SELECT entity_id AS target, id AS cycle_id, (lag(due_date) OVER (PARTITION BY entity_id ORDER BY due_date, id) + 1)::VARCHAR AS opens, due_date::VARCHAR AS closes FROM inst WHERE confidence = 'very_low'",
    "statement_rollup": """SELECT target, cycle_id, sum(k)::BIGINT AS n_inputs, sum(amount)::DOUBLE AS input_sum FROM (
  SELECT i.entity_id AS target, arg_min(s.id, (s.due_date, s.id)) AS cycle_id, 1 AS k, any_value(i.amount) AS amount FROM inst i LEFT JOIN (SELECT * FROM inst WHERE confidence = 'very_low') s ON s.entity_id = i.entity_id AND s.due_date >= i.due_date
    WHERE i.direction = 'outflow' AND i.confidence <> 'very_low' GROUP BY i.id, i.entity_id
  UNION ALL SELECT entity_id, id, 0, 0 FROM inst WHERE confidence = 'very_low') GROUP BY ALL""",
    "verify_duplicates": "SELECT obligation_id, due_date::VARCHAR AS due_date, count(*) AS n FROM inst GROUP BY ALL HAVING count(*) > 1",
    "verify_signs": "SELECT id, balance::DOUBLE AS amount FROM snap WHERE balance < 0",
    "verify_coverage_horizon": "SELECT obligation_id, max(due_date)::VARCHAR AS last_due FROM inst WHERE status <> 'paid' GROUP BY 1 HAVING count(*) FILTER (due_date >= DATE '1998-01-01' AND due_date < DATE '1998-01-01' + 90) = 0",
    "surface_queue": "SELECT id, finding_type AS kind, s AS severity_rank, k AS kind_rank, row_number() OVER (ORDER BY s DESC, k DESC, id) AS place FROM (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END::BIGINT AS s, CASE finding_type WHEN 'amount_changed' THEN 2 ELSE 1 END::BIGINT AS k FROM drifts) QUALIFY place <= 50",
    "snapshot_diff": f"SELECT coalesce(a.account_id, b.account_id) AS account_id, CASE WHEN a.account_id IS NULL THEN 'created' WHEN b.account_id IS NULL THEN 'resolved' WHEN a.balance = b.balance AND a.source = b.source THEN 'unchanged' ELSE 'updated' END AS action FROM ({_LATEST.format(_AS_OF % '2024-01-02')}) a FULL JOIN ({_LATEST.format(_AS_OF % '2024-01-20')}) b ON a.account_id = b.account_id",
    "emission_actions": """SELECT surface_key, CASE WHEN status = 'open' AND surface_key IN (SELECT 'pay:' || o_orderkey FROM orders WHERE o_orderkey % 5 = 4) THEN 'retire' WHEN new_hash IS NULL THEN NULL WHEN status = 'completed' THEN 'resolved'
  WHEN status = 'open' AND new_hash = old_hash THEN 'skip' WHEN status = 'open' THEN 'update' ELSE 'create' END AS action
  FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pay:' ELSE 'gone:' END || o_orderkey AS surface_key, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'open' ELSE 'retired' END AS status, o_orderpriority AS old_hash FROM orders)
  FULL JOIN (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'pay:' ELSE 'new:' END || o_orderkey AS surface_key, CASE WHEN o_totalprice > 200000 THEN '1-URGENT' ELSE o_orderpriority END AS new_hash FROM orders) USING (surface_key) WHERE action IS NOT NULL""",
    "subject_winners": "SELECT id, CASE WHEN direction = 'outflow' THEN entity_id END AS subject, CASE WHEN discretionary THEN 1 ELSE 0 END::BIGINT AS rank FROM inst WHERE status <> 'paid' QUALIFY direction = 'inflow' OR row_number() OVER (PARTITION BY direction, entity_id ORDER BY discretionary, id) = 1",
    "synthetic_ids": "SELECT id, ordinal, 'card:' || sha1(concat_ws('|', account_id, posted::VARCHAR, amount::VARCHAR, regexp_replace(lower(payee), '[^a-z0-9]', '', 'g'), ordinal)) AS synthetic_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id, posted, amount, payee ORDER BY id) - 1 AS ordinal FROM txn)",
    "memory_search": "SELECT query_id, rank, id, score, n_tokens FROM budget WHERE kept",
    "income_semi_monthly": "SELECT DISTINCT previous_business::VARCHAR AS pay_date FROM bus WHERE day BETWEEN DATE '2026-01-01' AND DATE '2026-12-31' AND (day(day) = 15 OR day = last_day(day)) AND previous_business >= DATE '2026-01-01'",
    "business_days": "SELECT day::VARCHAR AS day, is_business, previous_business::VARCHAR AS previous_business FROM bus WHERE day >= DATE '2026-01-01'",
}

#: Payments of the test tables and one for the two to four instances of a month, the day's pool of each, and its summing sets.
_LUMPS = f"""
pay AS (SELECT *, {_tokens("payee || ' ' || description")} AS said, abs(amount) AS target, CASE WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS direction FROM (
  SELECT id, account_id, posted, amount, payee, description FROM txn UNION ALL
  SELECT concat_ws('-', 'lump', entity_id, direction, month), entity_id, posted, (CASE direction WHEN 'inflow' THEN s ELSE -s END)::DECIMAL(18,2), 'Brand', 'month'
  FROM (SELECT entity_id, direction, strftime(due_date, '%Y-%m') AS month, sum(amount) AS s, max(due_date) AS posted FROM inst GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4)))"""
_GROUPS = """
pool AS (SELECT t.id AS t, i.id AS i, i.entity_id, i.direction, t.posted, t.target, i.amount, greatest(500.00, t.target * 0.010) AS slack FROM elig i JOIN pay t
  ON t.account_id = i.entity_id AND t.direction = i.direction AND t.posted BETWEEN i.due_date - 30 AND i.due_date + 30 AND list_has_any(i.words, t.said)),
sets AS (SELECT a.t, [a.i, b.i] AS ids FROM pool a JOIN pool b ON a.t = b.t AND a.i < b.i WHERE abs(a.amount + b.amount - a.target) <= a.slack UNION ALL
  SELECT a.t, [a.i, b.i, c.i] FROM pool a JOIN pool b ON a.t = b.t AND a.i < b.i JOIN pool c ON c.t = b.t AND b.i < c.i WHERE abs(a.amount + b.amount + c.amount - a.target) <= a.slack UNION ALL
  SELECT a.t, [a.i, b.i, c.i, d.i] FROM pool a JOIN pool b ON a.t = b.t AND a.i < b.i JOIN pool c ON c.t = b.t AND b.i < c.i JOIN pool d ON d.t = c.t AND c.i < d.i
    WHERE abs(a.amount + b.amount + c.amount + d.amount - a.target) <= a.slack),
asked AS (SELECT p.*, s.sets, row_number() OVER (PARTITION BY entity_id, direction ORDER BY posted, t) AS n FROM (SELECT t, entity_id, direction, posted, list(i) AS members FROM pool GROUP BY ALL) p
  JOIN (SELECT t, list(ids) AS sets FROM sets GROUP BY t) s USING (t)),
given AS (SELECT DISTINCT entity_id, direction, 0::BIGINT AS n, ''::VARCHAR AS t, []::BIGINT[] AS used, []::BIGINT[] AS pick FROM asked UNION ALL
  SELECT entity_id, direction, n, t, list_concat(used, pick), pick FROM (SELECT x.entity_id, x.direction, x.n, x.t, g.used,
    CASE WHEN len(list_filter(x.members, lambda m: NOT list_contains(g.used, m))) BETWEEN 2 AND 12 AND len(list_filter(x.sets, lambda e: NOT list_has_any(e, g.used))) = 1
      THEN list_filter(x.sets, lambda e: NOT list_has_any(e, g.used))[1] ELSE [] END AS pick
    FROM given g JOIN asked x ON x.entity_id = g.entity_id AND x.direction = g.direction AND x.n = g.n + 1)),
lumped AS (SELECT t AS transaction_id, unnest(pick) AS instance_id FROM given WHERE n > 0)"""


def _claims(pairs: str) -> str:
    """One step of a recursion per instance of an entity and direction, with the list of what is taken."""
    return f"""
firsts AS (SELECT i.entity_id, i.direction, p.instance_id, l, row_number() OVER (PARTITION BY i.entity_id, i.direction ORDER BY i.due_date, i.id) AS n FROM (
  SELECT instance_id, list({{'t': transaction_id, 's': score, 'm': match_type}} ORDER BY score DESC, abs(days), delta, transaction_id) AS l FROM {pairs} GROUP BY instance_id) p JOIN inst i ON i.id = p.instance_id),
claim AS (SELECT DISTINCT entity_id, direction, 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::BIGINT AS instance_id, {{'t': ''::VARCHAR, 's': 0::DOUBLE, 'm': ''::VARCHAR}} AS c FROM firsts UNION ALL
  SELECT entity_id, direction, n, CASE WHEN f.m <> 'below_threshold' THEN list_append(taken, f.t) ELSE taken END, instance_id, f FROM (
    SELECT x.entity_id, x.direction, x.n, c.taken, x.instance_id, list_filter(x.l, lambda e: NOT list_contains(c.taken, e.t))[1] AS f
    FROM claim c JOIN firsts x ON x.entity_id = c.entity_id AND x.direction = c.direction AND x.n = c.n + 1)),
claimed AS (SELECT instance_id, c.t AS transaction_id, c.s AS score, c.m AS match_type FROM claim WHERE n > 0 AND c.m <> 'below_threshold')"""


#: Further tables: one step of a recursion per event, or per hit, and obligations with their upper-median amounts.
STEPS = {
    "recon_greedy": _claims("pairs"),
    "recon_shared_groups": _LUMPS + ", elig AS (SELECT * FROM words_i)," + _GROUPS,
    "recon_run": _LUMPS + """,
due AS (SELECT w.*, i.status AS state FROM words_i w JOIN inst i USING (id) WHERE i.status IN ('expected', 'needs_review', 'partially_paid') AND i.due_date <= DATE '1998-06-30'),
wide AS (SELECT i.id AS instance_id, t.id AS transaction_id, (t.posted - i.due_date)::BIGINT AS days, abs(t.target - i.amount) AS delta,
  round(CASE WHEN len(words) = 0 OR len(said) = 0 THEN 0.0 ELSE len(list_intersect(words, said))::DOUBLE / len(list_distinct(list_concat(words, said))) END, 3) AS merchant_score
  FROM due i JOIN pay t ON i.entity_id = t.account_id AND i.direction = t.direction AND t.posted BETWEEN i.due_date - 30 AND i.due_date + 30 WHERE abs(t.target - i.amount) <= greatest(500.00, i.amount * 0.010)),
based AS (SELECT *, round(0.5::DOUBLE * CASE WHEN delta <= 0.005 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + 0.3::DOUBLE * CASE WHEN abs(days) <= 1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(days) - 1) / 30.0::DOUBLE) END
  + 0.2::DOUBLE * merchant_score, 3) AS base, delta < 0.005 AND abs(days) <= 2 AS sure FROM wide),
kinds AS (SELECT *, CASE WHEN sure THEN greatest(base, 0.9::DOUBLE) ELSE base END AS score, CASE WHEN sure THEN 'auto' WHEN merchant_score = 0 AND delta >= 0.005 THEN 'below_threshold'
  WHEN base >= 0.85 THEN 'auto' WHEN base >= 0.55 THEN 'needs_review' ELSE 'below_threshold' END AS match_type FROM based),
elig AS (SELECT * FROM due WHERE id NOT IN (SELECT instance_id FROM (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, abs(days), delta, transaction_id) = 1) WHERE match_type <> 'below_threshold')),
""" + _GROUPS + """,
rest AS (SELECT * FROM kinds WHERE instance_id NOT IN (SELECT instance_id FROM lumped) AND transaction_id NOT IN (SELECT transaction_id FROM lumped)),
""" + _claims("rest") + """,
paired AS (SELECT m.*, i.obligation_id, i.due_date, target FROM (SELECT instance_id, transaction_id, score, match_type, false AS grouped FROM claimed UNION ALL SELECT instance_id, transaction_id, NULL, 'needs_review', true FROM lumped) m
  JOIN inst i ON i.id = instance_id JOIN pay p ON p.id = transaction_id),
priced AS (SELECT *, last_value(CASE WHEN NOT grouped THEN target END IGNORE NULLS) OVER (PARTITION BY obligation_id ORDER BY due_date, instance_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS previous FROM paired),
judged AS (SELECT due.id, state, (DATE '1998-06-30' - due.due_date)::BIGINT AS age_days, transaction_id, score, match_type, grouped,
  coalesce(NOT grouped AND abs(target - previous) > 5.00 AND abs(target - previous) > previous * 0.10, false) AS amount_changed FROM due LEFT JOIN priced ON instance_id = due.id)""",
    "verify_overlap": """
ob AS (SELECT entity_id, obligation_id, direction, CASE any_value(name) WHEN 'Brand 3-MEDIUM' THEN '2' ELSE any_value(name)[7:7] END AS g, list(DISTINCT date_trunc('month', due_date)) AS months,
  list_sort(list(amount::DOUBLE))[count(*) // 2 + 1] AS mid FROM inst WHERE status <> 'paid' GROUP BY ALL)""",
    "project_capped_fold": """
fold AS (SELECT account_id AS entity_id, balance AS starting, 0::BIGINT AS seq, balance, balance AS low, DATE '1998-01-01' AS low_date FROM acc
  UNION ALL SELECT entity_id, starting, seq, b, least(b, low), CASE WHEN b < low THEN due_date ELSE low_date END FROM (
    SELECT f.entity_id, f.starting, e.seq, f.low, f.low_date, e.due_date, (f.balance + CASE WHEN e.direction = 'inflow' THEN e.amount WHEN e.discretionary
      THEN -(least(e.amount, e.required_minimum) + least(e.amount - least(e.amount, e.required_minimum), greatest(0, f.balance - least(e.amount, e.required_minimum) - 2500))) ELSE -e.amount END)::DECIMAL(18,2) AS b
    FROM fold f JOIN ev e ON e.entity_id = f.entity_id AND e.seq = f.seq + 1))""",
    "memory_search": f"""
mt AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM documents) WHERE len(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM benchmark) WHERE len(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
sc AS (SELECT query_id, id, round(dot / (mn * qn), 6) AS score, n_tokens::BIGINT AS n_tokens FROM (SELECT query_id, mt.id, sum(mt.tf * qt.tf)::DOUBLE AS dot FROM mt JOIN qt ON mt.term = qt.term GROUP BY ALL)
  JOIN (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS mn, sum(tf) AS n_tokens FROM mt GROUP BY 1) USING (id) JOIN (SELECT query_id, sqrt(sum(tf * tf)::DOUBLE) AS qn FROM qt GROUP BY 1) USING (query_id)),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score >= 0.1 QUALIFY rank <= 5),
budget AS (SELECT query_id, rank, id, score, n_tokens, true AS kept, n_tokens AS used FROM hit WHERE rank = 1
  UNION ALL SELECT h.query_id, h.rank, h.id, h.score, h.n_tokens, b.used + h.n_tokens <= 200, CASE WHEN b.used + h.n_tokens <= 200 THEN b.used + h.n_tokens ELSE b.used END FROM budget b JOIN hit h ON h.query_id = b.query_id AND h.rank = b.rank + 1)""",
}


BODY |= {
    "recon_greedy": "SELECT * FROM claimed",
    "recon_shared_groups": "SELECT * FROM lumped",
    "recon_run": """SELECT id AS instance_id, CASE WHEN match_type IS NULL THEN 'unmatched' WHEN grouped THEN 'shared' WHEN amount_changed THEN 'needs_review' ELSE match_type END AS outcome, transaction_id, score, amount_changed, age_days,
  match_type IS NULL AND age_days > 7 AS past_grace, CASE WHEN outcome = 'auto' THEN 'paid' WHEN match_type IS NULL AND age_days > 7 AND state = 'expected' THEN 'needs_review' ELSE state END AS status FROM judged""",
}


def sql() -> dict:
    from . import attention, feeds, ledgers, listings, manuals, rosters, settlements

    steps = STEPS | {"list_parity": listings.PARITY} | ledgers.steps() | feeds.STEPS | attention.steps() | settlements.steps() | manuals.STEPS
    return {k: f"WITH RECURSIVE {BASE}{',' + steps[k] if k in steps else ''}\n{body}" for k, body in (BODY | rosters.SQL | listings.SQL | ledgers.sql() | feeds.SQL | attention.sql() | settlements.SQL | manuals.SQL).items()}
