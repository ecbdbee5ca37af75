"""Adapters, source mappers and sinks over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

BAR = "open high low close"


@query("adapter_bars", "SELECT * FROM bars", BAR)
def adapter_bars(spark, sf):
    return A.bars(spark, sf)


@query("adapter_weekly_bars", "SELECT * FROM wbars", BAR)
def adapter_weekly(spark, sf):
    return A.bars(spark, sf, grain="week")


@query("adapter_supplier_bars", "SELECT * FROM sbars", BAR)
def adapter_supplier(spark, sf):
    return A.bars(spark, sf, symbol="l_suppkey", grain="month")


@query("adapter_market", "SELECT * FROM market", "close")
def adapter_market(spark, sf):
    return A.market(spark, sf)


@query("adapter_profiles", "SELECT * FROM profiles", "market_cap")
def adapter_profiles(spark, sf):
    return A.profiles(spark, sf)


@query("adapter_supplier_profiles", "SELECT * FROM sprofiles", "market_cap")
def adapter_sprofiles(spark, sf):
    return A.supplier_profiles(spark, sf)


@query("adapter_income", "SELECT * EXCLUDE (rev_u) FROM income",
       "revenue:4 gross_profit:4 operating_income:4 net_income:4 ebitda:4 eps_diluted shares_diluted")
def adapter_income(spark, sf):
    return A.income(spark, sf).drop("revenue_units")


@query("adapter_balance", "SELECT * FROM balance", "total_assets:3 total_equity:3 total_debt:3 net_debt:3")
def adapter_balance(spark, sf):
    return A.balance(A.income(spark, sf))


@query("adapter_cashflow", "SELECT * FROM cashflow", "operating_cf:4 free_cash_flow:4 dividends_paid:4")
def adapter_cashflow(spark, sf):
    return A.cashflow(A.income(spark, sf))


@query("adapter_earnings", "SELECT * FROM earnings", "eps_actual eps_estimated revenue_actual:4 revenue_estimated:4")
def adapter_earnings(spark, sf):
    return A.earnings(A.income(spark, sf))


@query("adapter_grades", "SELECT * FROM grades")
def adapter_grades(spark, sf):
    return A.grades(spark, sf)


@query("adapter_macro", "SELECT * FROM macro", "value")
def adapter_macro(spark, sf):
    return A.macro(spark, sf)


@query("adapter_membership_log", "SELECT * FROM member_log")
def adapter_log(spark, sf):
    return A.membership(A.bars(spark, sf))[0]


@query("adapter_membership_now", "SELECT * FROM member_now")
def adapter_now(spark, sf):
    return A.membership(A.bars(spark, sf))[1]


@query("adapter_trades", "SELECT * FROM trades", "price amount pnl:4 pnl_pct shares")
def adapter_trades(spark, sf):
    return A.trades(spark, sf)


@query("adapter_accounts", "SELECT * FROM accounts")
def adapter_accounts(spark, sf):
    return A.accounts(spark, sf)


@query("adapter_ticks", "SELECT event_type AS symbol, ts, value AS price, user_id, event_id FROM events", "price")
def adapter_ticks(spark, sf):
    return A.ticks(spark, sf)
