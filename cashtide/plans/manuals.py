"""Queries of accounts asked for by name and of balances entered by hand, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manual, recurring
from ..sources import adapters

#: Account names by key, as the test tables have none that differ; forty accounts belong to one owner.
FIRST = ("Everyday", "Premier", "Vacation", "Household", "Travel", "Emergency", "Business", "Student")
SECOND = ("Checking", "Savings", "Card", "Loan", "Reserve")


def _accounts(spark, d):
    k = F.col("account_id")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    name = F.concat_ws(" ", pick(FIRST, k), pick(SECOND, F.floor(k / 8)), F.lpad((k * 7919 % 10000).cast("string"), 4, "0"))
    return adapters.accounts(spark, d).select("account_id", F.floor(k / 40).alias("entity_id"), name.alias("name"), "org", "balance")


def _entries(spark, d):
    """Three entries an account, six ways of asking in turn: the words, a letter dropped, two letters turned, the last word alone, the number's end, something else."""
    k, n = F.col("account_id"), F.col("n")
    words = F.substring_index("name", " ", 2)
    turned = F.concat(F.substring(words, 2, 1), F.substring(words, 1, 1), F.substring(words, 3, 99))
    dropped = F.concat(F.substring(words, 1, 2), F.substring(words, 4, 99))
    how = ((k + n) % 6).cast("int")
    query = adapters.by_value(how, {0: F.upper(words), 1: dropped, 2: turned, 3: F.substring_index(words, " ", -1), 4: F.concat(F.lit("acct ("), F.substring_index("name", " ", -1), F.lit(")"))}, F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.col("org")).otherwise("zqxv"))
    rows = _accounts(spark, d).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    as_of = F.date_format(F.date_add(F.lit("2024-01-04").cast("date"), (k % 20 + n * (k % 3)).cast("int")), "yyyy-MM-dd")
    return rows.select(
        (n * 100000000 + k).alias("entry_id"), "entity_id", query.alias("query"), F.when(k % 17 != 0, F.when(n == 1, -F.col("balance") / 8).otherwise(F.col("balance") / 8).cast(adapters.MONEY)).alias("balance"),
        F.when(k % 19 == 0, "soon").otherwise(as_of).alias("as_of"), F.repeat(F.lit("n"), F.when(k % 23 == 0, 501).otherwise(5)).alias("note"),
    )


def account_lookup(spark, d):
    asked = _entries(spark, d).select(F.col("entry_id").alias("ask_id"), "entity_id", "query")
    return manual.resolve(asked, _accounts(spark, d))


def _placed(spark, d):
    return manual.placed(_entries(spark, d), _accounts(spark, d), adapters.snapshots(spark, d))


def manual_balances(spark, d):
    return _placed(spark, d).drop("note")


def manual_replaced(spark, d):
    return manual.entered(_placed(spark, d), adapters.snapshots(spark, d))


def charge_policies(spark, d):
    """Payees by brand: some are named after usage, some look like own transfers, some say usage in the description alone, some charge a fixed sum."""
    brand = F.regexp_extract("payee", "[0-9]+$", 0).cast("int")
    t = adapters.transactions(spark, d).withColumn("b", brand)
    payee = F.when(F.col("b") % 5 == 1, F.concat(F.lit("City Electric "), "b")).when(F.col("b") % 5 == 2, F.concat(F.lit("Online Transfer "), "b")).otherwise(F.col("payee"))
    said = F.when(F.col("b") % 5 == 3, F.concat("description", F.lit(" 12 kWh"))).otherwise(F.col("description"))
    paid = F.when(F.col("b") % 5 == 0, F.when(F.col("amount") < 0, -(F.col("b") + 10)).otherwise(F.col("b") + 10)).otherwise(F.col("amount")).cast(adapters.MONEY)
    rows = t.withColumns({"payee": payee, "description": said, "amount": paid}).drop("b")
    return recurring.policies(recurring.candidates(recurring.statistics(rows, adapters.accounts(spark, d), with_inflows=True)))


ALL = (account_lookup, manual_balances, manual_replaced, charge_policies)

_WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
_ASKED = f"""own AS (SELECT account_id AS k, account_id // 40 AS e, {_WORDS(FIRST)}[(account_id % 8 + 1)::INT] || ' ' || {_WORDS(SECOND)}[(account_id // 8 % 5 + 1)::INT] AS two, lpad((account_id * 7919 % 10000)::VARCHAR, 4, '0') AS tail, org, balance FROM acc),
ent AS (SELECT n * 100000000 + k AS entry_id, k, e, CASE (k + n) % 6 WHEN 0 THEN upper(two) WHEN 1 THEN two[1:2] || two[4:] WHEN 2 THEN two[2] || two[1] || two[3:] WHEN 3 THEN split_part(two, ' ', 2) WHEN 4 THEN 'acct (' || tail || ')'
  ELSE CASE k % 4 WHEN 0 THEN '  ' WHEN 1 THEN org ELSE 'zqxv' END END AS query, CASE WHEN k % 17 <> 0 THEN round(CASE n WHEN 1 THEN -balance ELSE balance END / 8::DECIMAL(18,2), 6)::DECIMAL(22,6)::DECIMAL(18,2) END AS balance,
  CASE WHEN k % 19 <> 0 THEN DATE '2024-01-04' + (k % 20 + n * (k % 3))::INT END AS as_of, CASE WHEN k % 23 = 0 THEN 501 ELSE 5 END AS note_length FROM own, range(3) r(n)),
q AS (SELECT entry_id, e, trim(regexp_replace(lower(trim(query)), '\\(?\\s*[0-9]{{4}}\\s*\\)?\\s*$', ''), ' (*.-x') AS bare, regexp_extract(lower(query), '([0-9]{{4}})\\s*\\)?\\s*$', 1) AS mask, lower(trim(query)) AS said FROM ent),
ask AS (SELECT entry_id, e, mask, CASE WHEN mask <> '' AND bare <> '' THEN bare ELSE said END AS q FROM q),
met AS (SELECT a.*, o.k, lower(two || ' ' || tail) AS name, lower(org) AS org, mask <> '' AND (contains(two || ' ' || tail, mask) OR contains(o.k::VARCHAR, mask)) AS carries FROM ask a JOIN own o ON a.e = o.e),
g AS (SELECT *, {_GRAMS.format("q")} AS qg, {_GRAMS.format("name")} AS ng, {_GRAMS.format("org")} AS og, count(*) FILTER (carries) OVER (PARTITION BY entry_id) AS n_carry FROM met WHERE q <> ''),
pts AS (SELECT *, greatest(len(list_intersect(qg, ng)) * 20000 // greatest(len(qg) + len(ng), 1), CASE WHEN contains(name, q) THEN 9000 ELSE 0 END) AS np,
  greatest(len(list_intersect(qg, og)) * 20000 // greatest(len(qg) + len(og), 1), CASE WHEN len(list_filter(string_split(q, ' '), lambda w: w <> '' AND contains(org, w))) > 0 THEN 9000 ELSE 0 END) AS op FROM g WHERE n_carry = 0 OR carries),
top AS (SELECT *, max(score) OVER (PARTITION BY entry_id) AS top FROM (SELECT *, CASE n_carry WHEN 1 THEN 10000 ELSE np + op * 3 // 20 END AS score FROM pts)),
hit AS (SELECT entry_id, max(top) AS score, count(*) AS n_close, arg_max(k, score) AS k FROM top WHERE top >= 4000 AND top - score <= 1000 GROUP BY entry_id),
res AS (SELECT entry_id AS ask_id, CASE WHEN n_close IS NULL THEN 'not_found' WHEN n_close = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE n_close WHEN 1 THEN hit.k END AS account_id, score::BIGINT AS score, coalesce(n_close, 0) AS n_close
  FROM ent LEFT JOIN hit USING (entry_id)),
pre AS (SELECT e.*, CASE WHEN trim(query) = '' OR balance IS NULL OR as_of IS NULL OR note_length > 500 THEN 'invalid' ELSE status END AS status, account_id FROM ent e JOIN res ON ask_id = entry_id),
num AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY entry_id) AS i FROM pre WHERE status = 'ok'),
chain AS (SELECT n.*, CASE WHEN m.newest >= n.noon THEN m.newest + 1 ELSE n.noon END AS stamp FROM (SELECT *, epoch(as_of::TIMESTAMP)::BIGINT + 43200 AS noon FROM num WHERE i = 1) n LEFT JOIN (SELECT account_id, max(epoch_us(recorded_at) // 1000000) AS newest FROM snap GROUP BY account_id) m USING (account_id)
  UNION ALL SELECT n.*, epoch(n.as_of::TIMESTAMP)::BIGINT + 43200, CASE WHEN c.stamp >= epoch(n.as_of::TIMESTAMP)::BIGINT + 43200 THEN c.stamp + 1 ELSE epoch(n.as_of::TIMESTAMP)::BIGINT + 43200 END FROM chain c JOIN num n ON n.account_id = c.account_id AND n.i = c.i + 1),
fed AS (SELECT account_id, arg_max(balance, (recorded_at, id)) AS feed FROM snap WHERE source <> 'manual' AND balance <> 0 GROUP BY account_id),
done AS (SELECT c.*, coalesce(sign(balance) * sign(feed) < 0 AND abs(balance) * 4 >= abs(feed) AND abs(balance) <= abs(feed) * 4, false) AS turned FROM chain c LEFT JOIN fed USING (account_id)),
hand AS (SELECT 'stored' AS origin, id, account_id, balance, epoch_us(recorded_at) AS us, -1 AS turn FROM snap WHERE source = 'manual'
  UNION ALL SELECT 'entered', entry_id, account_id, CASE WHEN turned THEN -balance ELSE balance END, stamp * 1000000, entry_id FROM done)"""
_TIME = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S.%f')"
SQL = {
    "account_lookup": "SELECT * FROM res",
    "manual_balances": f"""SELECT p.entry_id, p.status, CASE WHEN p.status = 'ok' THEN p.account_id END AS account_id, (CASE WHEN d.turned THEN -d.balance ELSE d.balance END)::DOUBLE AS balance, {_TIME.format("d.stamp * 1000000")} AS recorded_at,
  d.as_of::VARCHAR AS as_of, coalesce(d.turned, false) AS sign_corrected FROM pre p LEFT JOIN done d ON d.entry_id = p.entry_id""",
    "manual_replaced": f"""SELECT origin, id, account_id, balance::DOUBLE AS balance, {_TIME.format("us")} AS recorded_at,
  (SELECT min(e.entry_id) FROM done e WHERE e.account_id = h.account_id AND e.entry_id > h.turn AND e.as_of = make_timestamp(h.us)::DATE) AS replaced_by FROM hand h""",
}
_CHARGED = """bt AS (SELECT t.account_id, t.id, posted, kind AS class, regexp_extract(payee, '[0-9]+$')::INT AS b, amount, payee FROM txn t JOIN acc a ON t.account_id = a.account_id),
bp AS (SELECT account_id, id, posted, class, b % 5 IN (1, 3) AS usage, b % 5 = 2 AS internal, CASE b % 5 WHEN 1 THEN 'City Electric ' || b WHEN 2 THEN 'Online Transfer ' || b ELSE payee END AS payee, CASE WHEN amount < 0 THEN 'outflow' ELSE 'inflow' END AS direction,
  (CASE b % 5 WHEN 0 THEN b + 10 ELSE abs(amount) END)::DECIMAL(18,2) AS paid FROM bt WHERE amount <> 0),
bg AS (SELECT *, posted - lag(posted) OVER (PARTITION BY account_id, payee, class, direction ORDER BY posted, id) AS gap FROM bp),
bs AS (SELECT account_id, payee, class, direction, any_value(usage) AS usage, any_value(internal) AS internal, count(*) AS n, avg(paid::DOUBLE) AS mean, median(paid::DOUBLE) AS mid, stddev_pop(paid::DOUBLE) / avg(paid::DOUBLE) AS cv, median(gap)::DOUBLE AS step,
  list(gap) FILTER (gap IS NOT NULL) AS gaps, list(paid ORDER BY posted DESC, id DESC)[1:3] AS recent, max(posted) AS last, (round_even((max(posted) - min(posted)) / 30.44::DOUBLE, 0) + 1)::BIGINT AS months,
  round_even(median(day(posted))::DOUBLE, 0)::BIGINT AS typical_day, max(day(posted)) - min(day(posted)) AS day_spread FROM bg GROUP BY ALL HAVING count(*) >= 2),
bk AS (SELECT *, list_transform(list_append(gaps, step), lambda g: CASE WHEN g < 4 THEN 'unknown' WHEN g <= 10 THEN 'weekly' WHEN g <= 18 THEN 'biweekly' WHEN g <= 37 THEN 'monthly' WHEN g <= 75 THEN 'irregular_multiweek' WHEN g <= 100 THEN 'quarterly' ELSE 'irregular' END) AS labels FROM bs),
bc AS (SELECT *, CASE WHEN labels[-1] LIKE 'irregular%' OR len(list_filter(labels[1:-2], lambda x: x = labels[-1])) >= 3 THEN labels[-1] ELSE 'unknown' END AS cadence,
  CASE WHEN direction = 'outflow' AND class = 'card' AND usage THEN 'seasonal_card_spend' WHEN direction = 'outflow' AND class IN ('checking', 'savings') AND usage AND cv > 0.08 THEN 'seasonal_multiplier' WHEN list_max(recent) - list_min(recent) <= greatest(0.01, list_max(recent)::DOUBLE * 0.01) THEN 'last'
    WHEN cv <= 0.05 THEN 'fixed' WHEN cv <= 0.2 THEN 'average' ELSE 'needs_review' END AS m FROM bk),
bd AS (SELECT *, CASE WHEN n >= 4 AND months >= 4 AND cadence IN ('weekly', 'biweekly', 'monthly') AND cv <= 0.1 THEN 'high' WHEN n >= 3 AND months >= 3 AND cadence IN ('weekly', 'biweekly', 'monthly', 'irregular_multiweek') THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN direction = 'inflow' THEN 'inflow' WHEN internal THEN 'internal_transfer' WHEN m = 'needs_review' AND NOT usage THEN 'variable_spend' WHEN class = 'card' THEN 'card_statement_input' WHEN class IN ('checking', 'savings') THEN 'direct_checking_outflow' ELSE 'review_only' END AS candidate_type,
  CASE WHEN direction = 'inflow' THEN 'inflow' WHEN class = 'card' THEN 'card_statement_input' WHEN class IN ('checking', 'savings') THEN 'direct_checking' ELSE 'review_only' END AS treatment, CASE WHEN m LIKE 'seasonal%' THEN 1.5::DOUBLE END AS peak FROM bc),
be AS (SELECT *, concat_ws(',', CASE WHEN n < 4 THEN 'few_charges' END, CASE WHEN peak > 0 AND months < 12 THEN 'seasonal_under_a_year' END, CASE WHEN cv > 0.2 THEN 'amounts_vary' END, CASE WHEN treatment = 'card_statement_input' THEN 'statement_cycle_unknown' END,
  CASE WHEN cadence LIKE 'irregular%' OR cadence = 'unknown' THEN 'timing_lumpy' END) AS missing FROM bd)"""
SQL["charge_policies"] = """SELECT account_id, trim(regexp_replace(lower(payee), '[^a-z0-9]+', '_', 'g'), '_') AS merchant_key, class, direction, payee AS display_name, treatment, candidate_type, cadence, confidence, typical_day, day_spread,
  (last + round_even(step, 0)::INT)::VARCHAR AS next_date, CASE m WHEN 'last' THEN 'fixed' ELSE m END AS policy, round((CASE m WHEN 'last' THEN recent[1]::DOUBLE WHEN 'needs_review' THEN mid ELSE mean END)::DECIMAL(28,10), 2)::DOUBLE AS proposed, peak AS summer_multiplier, peak AS winter_multiplier, missing,
  concat_ws(',', CASE WHEN confidence = 'low' THEN 'confidence_low' END, CASE WHEN candidate_type IN ('card_statement_input', 'internal_transfer', 'variable_spend') THEN candidate_type END, CASE WHEN missing <> '' THEN 'evidence_missing' END) AS reasons FROM be"""
STEPS = dict.fromkeys(SQL, _ASKED) | {"charge_policies": _CHARGED}
