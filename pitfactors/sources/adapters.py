"""Domain tables derived from the star-schema files.

Money is summed in whole units (cents and below), so every total is exact and does not
depend on the order in which partitions arrive.  Fact rows are aggregated to
``(symbol, date)`` here, map-side first: a hot symbol shrinks to at most one row per
calendar day before anything is partitioned by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitfactors.functions import scale

GRAINS = {"day": None, "week": "week", "month": "month"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def percent(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def at_grain(c: str, grain: str) -> Column:
    unit = GRAINS[grain]
    return F.to_date(F.col(c)) if unit is None else F.to_date(F.date_trunc(unit, F.col(c)))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading dates: one column of one table."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


def lines(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", start: str | None = None, end: str | None = None) -> DataFrame:
    """Line items with their symbol: a column of ``part``, or the supplier key.

    A date range is put on the stored column, so it reaches the file scan.
    """
    items = table(spark, sf_dir, "lineitem")
    kind = items.schema["l_shipdate"].dataType
    if start is not None:
        items = items.filter(F.col("l_shipdate") >= F.lit(start).cast(kind))
    if end is not None:
        items = items.filter(F.col("l_shipdate") < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    if symbol == "l_suppkey":
        return items.withColumn("symbol", F.col("l_suppkey").cast("string"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col(symbol).alias("symbol")
    )
    return items.join(parts, "l_partkey")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", grain: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    # One long orders the lines: order and line number, then the low bits of the part key.
    first = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey") % 1048576
    return (
        lines(spark, sf_dir, symbol, start, end)
        .groupBy("symbol", at_grain("l_shipdate", grain).alias("date"))
        .agg(
            F.min_by(unit, first).alias("open"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum(cents("l_extendedprice")).alias("_cents"),
            F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        )
        .select(
            "symbol", "date", "open", "high", "low",
            (F.col("_cents") / F.lit(100.0) / F.col("volume")).alias("close"),
            "volume",
        )
    )


def market(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """One index series over all line items."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(at_grain("l_shipdate", grain).alias("date"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("_c"),
            F.sum(F.col("l_quantity").cast("long")).alias("_q"),
        )
        .select("date", (F.col("_c") / F.lit(100.0) / F.col("_q")).alias("close"))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    totals = (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg((F.sum(cents("p_retailprice")) / F.lit(100.0)).alias("market_cap"), F.count(F.lit(1)).alias("parts"))
    )
    num = F.col("num")
    return totals.withColumn("num", number).select(
        F.col("p_brand").alias("symbol"),
        F.concat(F.lit("Maker "), num.cast("string")).alias("name"),
        F.concat(F.lit("S"), (num % 5).cast("string")).alias("sector"),
        F.concat(F.lit("I"), (num % 7).cast("string")).alias("industry"),
        F.when(num % 3 == 0, "NYSE").when(num % 3 == 1, "NASDAQ").otherwise("OTC").alias("exchange"),
        F.when(num % 2 == 0, "US").otherwise("CA").alias("country"),
        (num % 4 != 0).alias("active"),
        "market_cap",
        F.lpad(num.cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("US"), F.lpad(num.cast("string"), 10, "0")).alias("isin"),
        F.concat(F.lit("C"), F.lpad(num.cast("string"), 8, "0")).alias("cusip"),
    )


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string")).alias("sector"),
        ((cents("s_acctbal") + 200000) / F.lit(100.0)).alias("market_cap"),
    )


def income(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    units = cents("l_extendedprice") * (100 - percent("l_discount"))
    rev, ext, qty = F.col("_rev") / F.lit(10000.0), F.col("_ext") / F.lit(100.0), F.col("_qty")
    return (
        lines(spark, sf_dir, symbol)
        .groupBy("symbol", quarter.alias("q"))
        .agg(
            F.sum(units).alias("_rev"),
            F.sum(cents("l_extendedprice")).alias("_ext"),
            F.sum(F.col("l_quantity").cast("long")).alias("_qty"),
        )
        .select(
            "symbol",
            F.last_day(F.add_months("q", 2)).alias("date"),
            F.year("q").alias("fiscal_year"),
            F.concat(F.lit("Q"), F.quarter("q").cast("string")).alias("period"),
            rev.alias("revenue"),
            (rev - 0.6 * ext).alias("gross_profit"),
            (rev - 0.8 * ext).alias("operating_income"),
            (rev - 0.9 * ext).alias("net_income"),
            (rev - 0.75 * ext).alias("ebitda"),
            ((rev - 0.9 * ext) / qty).alias("eps_diluted"),
            qty.cast("double").alias("shares_diluted"),
            F.col("_rev").alias("revenue_units"),
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``income`` materialised: symbols times quarters, read by every statement table."""
    return scale.stable(income(spark, sf_dir))


def balance(income_df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    assets = F.sum("revenue_units").over(w) / F.lit(10000.0)
    return income_df.select("symbol", "date", "fiscal_year", "period", assets.alias("total_assets")).select(
        "*",
        (0.5 * F.col("total_assets")).alias("total_equity"),
        (0.3 * F.col("total_assets")).alias("total_debt"),
        (0.2 * F.col("total_assets")).alias("net_debt"),
    )


def cashflow(income_df: DataFrame) -> DataFrame:
    ni = F.col("net_income")
    return income_df.select(
        "symbol", "date", "fiscal_year", "period",
        (1.1 * ni).alias("operating_cf"), (0.8 * ni).alias("free_cash_flow"), (-0.1 * ni).alias("dividends_paid"),
    )


def earnings(income_df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    lag_days = 10 + 7 * F.substring("period", 2, 1).cast("int")
    return income_df.select(
        "symbol",
        F.date_add("date", lag_days).alias("date"),
        F.col("eps_diluted").alias("eps_actual"),
        F.lag("eps_diluted").over(w).alias("eps_estimated"),
        F.col("revenue").alias("revenue_actual"),
        F.lag("revenue").over(w).alias("revenue_estimated"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst actions: one row per order line, symbol from the part."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority", "o_custkey"
    )
    level = F.substring("o_orderpriority", 1, 1)
    return (
        lines(spark, sf_dir)
        .join(orders, "l_orderkey")
        .select(
            "symbol",
            F.to_date("o_orderdate").alias("date"),
            F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")).alias("grading_company"),
            F.when(level == "1", "upgrade").when(level == "5", "downgrade").otherwise("maintain").alias("action"),
        )
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series"))
        .agg(F.sum(cents("o_totalprice")).alias("_c"), F.count(F.lit(1)).alias("_n"))
        .select("date", "series", (F.col("_c") / F.lit(100.0) / F.col("_n")).alias("value"))
    )


def membership(bars_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change log, snapshot): added on the first bar, removed on the last if it left."""
    spans = bars_df.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    final = bars_df.agg(F.max("date")).scalar()
    spans = spans.withColumn("left", F.col("last") < final)
    actions = F.array(
        F.struct(F.col("first").alias("event_date"), F.lit("added").alias("action")),
        F.struct(F.col("last").alias("event_date"), F.lit("removed").alias("action")),
    )
    log = (
        spans.select("symbol", "left", F.inline(actions))
        .filter((F.col("action") == "added") | F.col("left"))
        .drop("left")
    )
    return log, spans.filter(~F.col("left")).select("symbol")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade ledger: one row per line item; a returned item is a sale."""
    sell = F.col("l_returnflag") == "R"
    held = (F.col("l_partkey") % 90 + 1).cast("int")
    edge = 4 - percent("l_tax")
    reason = (
        F.when(~sell, "entry_signal")
        .when(F.col("l_linenumber") % 4 == 0, "stop_loss")
        .when(F.col("l_linenumber") % 4 == 1, "take_profit")
        .when(F.col("l_linenumber") % 4 == 2, "time_stop")
        .otherwise("backtest_end")
    )
    day = F.to_date("l_shipdate")
    return lines(spark, sf_dir).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("trade_key"),
        F.col("l_suppkey").alias("book"),
        F.concat(F.lit("sleeve"), (F.col("l_linenumber") % 3).cast("string")).alias("sleeve"),
        F.year(day).alias("window_year"),
        day.alias("date"),
        F.when(sell, "SELL").otherwise("BUY").alias("action"),
        "symbol",
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("amount"),
        cents("l_extendedprice").alias("amount_cents"),
        reason.alias("reason"),
        F.when(sell, F.date_sub(day, held)).alias("entry_date"),
        F.when(sell, held).alias("days_held"),
        F.when(sell, edge.cast("double")).alias("pnl_pct"),
        F.when(sell, cents("l_extendedprice") * edge).alias("pnl_units"),
        F.when(sell, cents("l_extendedprice") * edge / F.lit(10000.0)).alias("pnl"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor cash flows: fund = region, negative when the order is still pending."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sign = F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    return (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .join(nations, "n_nationkey")
        .select(
            F.col("n_regionkey").cast("string").alias("fund"),
            F.col("o_custkey").alias("investor"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderkey").alias("flow_id"),
            (sign * cents("o_totalprice")).alias("amount_cents"),
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "user_id", "event_id"
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research claims: one per customer, with a JSON specification whose key order varies."""
    k = F.col("c_custkey")
    primary = F.element_at(F.array(F.lit("mom"), F.lit("rev"), F.lit("vol")), (k % 3 + 1).cast("int"))
    other = F.element_at(F.array(F.lit("rev"), F.lit("vol"), F.lit("mom"), F.lit("mom")), (k % 4 + 1).cast("int"))
    horizon = F.element_at(F.array(F.lit("21"), F.lit("63"), F.lit("0")), (k % 7 % 3 + 1).cast("int"))
    hypothesis = F.when(k % 11 == 0, "unclear").otherwise("cheap_beats_expensive")
    pair = lambda n, v, q='"': F.concat(F.lit(f'"{n}":{q}'), v, F.lit(q))
    parts = [pair("conditioning_factor", other), pair("horizon_days", horizon, ""), pair("hypothesis", hypothesis), pair("primary_factor", primary)]
    sorted_spec = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    mixed_spec = F.concat(F.lit("{"), F.concat_ws(",", *parts[::-1]), F.lit("}"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("validated", "rejected", "candidate", "regime_reversing", "validated_conditional")]), (k % 5 + 1).cast("int"))
    regimes = F.when(k % 6 == 0, "holds in calm; REVERSES in hot").when(k % 6 == 1, "holds in calm").when(k % 6 == 2, "REVERSES in hot")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("universe"),
        F.when(k % 2 == 0, sorted_spec).otherwise(mixed_spec).alias("test_spec"), status.alias("status"), regimes.alias("regime_conditions"),
        (k % 13).alias("promotions"), cents("c_acctbal").alias("created"))
