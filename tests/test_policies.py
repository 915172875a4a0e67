from datetime import date, timedelta
from decimal import Decimal as D

from cashtide.operators import recurring

TXN = "id string, account_id long, posted date, amount decimal(18,2), payee string, description string, pending boolean"
KINDS = {1: "checking", 2: "card", 3: "savings", 4: "loan"}


def policies(spark, charges):
    """charges: account, payee, description, amounts, first day, days between."""
    rows = [(f"{k}-{n}", a, start + timedelta(days=n * gap), D(str(-x)), payee, said, False) for k, (a, payee, said, xs, start, gap) in enumerate(charges) for n, x in enumerate(xs)]
    accounts = spark.createDataFrame(list(KINDS.items()), "account_id long, kind string")
    stats = recurring.statistics(spark.createDataFrame(rows, TXN), accounts)
    return {(r.account_id, r.merchant_key): r for r in recurring.policies(recurring.candidates(stats)).collect()}


def test_seasonal_treatments_and_what_is_missing(spark):
    first = date(2026, 1, 15)
    got = policies(spark, [
        (1, "City Power", "", (50, 90, 140, 60, 55), first, 30), (2, "City Power", "", (50, 50, 50, 50, 50), first, 30), (3, "Home Supply", "12 kWh used", (50, 90, 140, 60), first, 30),
        (1, "Gym", None, (20, 20, 20, 20, 20), first, 30), (4, "Lender", "", (10, 99), first, 50), (1, "Quarterly Club", "", (30, 30, 30, 30), first, 90),
    ])
    a = got[1, "city_power"]
    assert (a.policy, a.treatment, a.summer_multiplier, a.winter_multiplier, a.proposed) == ("seasonal_multiplier", "direct_checking", 1.5, 1.5, D("79.00"))
    assert (a.missing, a.next_date, a.typical_day, a.day_spread) == ("seasonal_under_a_year,amounts_vary", date(2026, 6, 14), 15, 2)
    card = got[2, "city_power"]
    assert (card.policy, card.missing, card.reasons) == ("seasonal_card_spend", "seasonal_under_a_year,statement_cycle_unknown", "card_statement_input,evidence_missing")
    said = got[3, "home_supply"]
    assert (said.policy, said.treatment, said.candidate_type) == ("seasonal_multiplier", "direct_checking", "direct_checking_outflow")
    gym = got[1, "gym"]
    assert (gym.policy, gym.summer_multiplier, gym.missing, gym.reasons, gym.confidence, gym.display_name) == ("fixed", None, "", "", "high", "Gym")
    loan = got[4, "lender"]
    assert (loan.treatment, loan.candidate_type, loan.missing) == ("review_only", "variable_spend", "few_charges,amounts_vary,timing_lumpy")
    assert got[1, "quarterly_club"].cadence == "quarterly" and got[1, "quarterly_club"].confidence == "low"


def test_inflows_have_no_season(spark):
    rows = [(str(n), 1, date(2026, 1, 1) + timedelta(days=30 * n), D(x), "City Power", "", False) for n, x in enumerate(("50.00", "90.00", "140.00"))]
    accounts = spark.createDataFrame([(1, "checking")], "account_id long, kind string")
    stats = recurring.statistics(spark.createDataFrame(rows, TXN), accounts, with_inflows=True)
    assert [(r.policy, r.treatment, r.candidate_type) for r in recurring.policies(recurring.candidates(stats)).collect()] == [("needs_review", "inflow", "inflow")]


def test_span_counts_months_without_charges(spark):
    rows = [(str(n), 1, day, D("-10.00"), "Club", "", False) for n, day in enumerate((date(2025, 11, 30), date(2026, 3, 1)))]
    accounts = spark.createDataFrame([(1, "checking")], "account_id long, kind string")
    assert [r.span_months for r in recurring.statistics(spark.createDataFrame(rows, TXN), accounts).collect()] == [5]
