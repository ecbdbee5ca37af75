"""Vendor documents: readers of wrapped JSON and mappers to the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vendor's record fields per document kind.
RECORDS = {
    "prices": "date date, open double, high double, low double, close double, volume bigint, changePercent double, vwap double",
    "income": "date date, fiscalYear string, period string, revenue double, grossProfit double, operatingIncome double, netIncome double, ebitda double, eps double, epsDiluted double, weightedAverageShsOutDil double",
    "balance": "date date, fiscalYear string, period string, cashAndCashEquivalents double, inventory double, totalCurrentAssets double, totalAssets double, totalCurrentLiabilities double, shortTermDebt double, longTermDebt double, totalLiabilities double, totalStockholdersEquity double",
    "cashflow": "date date, fiscalYear string, period string, netCashProvidedByOperatingActivities double, investmentsInPropertyPlantAndEquipment double, commonDividendsPaid double, commonStockRepurchased double",
    "earnings": "date date, epsActual double, epsEstimated double, revenueActual double, revenueEstimated double",
    "insider_trades": "transactionDate date, reportingName string, typeOfOwner string, transactionType string, securitiesTransacted double, price double, securitiesOwned double",
    "analyst_grades": "date date, gradingCompany string, previousGrade string, newGrade string, action string",
    "index_changes": "date date, symbol string, removedTicker string, reason string",
    "delisted": "symbol string, companyName string, exchange string, ipoDate date, delistedDate date",
    "key_metrics": "date date, earningsYield double",
}
US_EXCHANGES = ("NYSE", "NASDAQ", "AMEX", "NYSEARCA", "BATS")


def wrapped(record: str) -> str:
    return f"struct<_fetched_at:string,data:array<struct<{_fields(record)}>>>"


def _fields(record: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.strip().split() for x in record.split(", ")))


def read_documents(spark: SparkSession, path: str, kind: str, position: bool = False) -> DataFrame:
    """Files ``<symbol>.json`` holding ``{"_fetched_at": …, "data": […]}`` → one row per record.

    ``position`` adds ``load_order`` (time of the fetch, place in the file) for merging.
    """
    schema = f"_fetched_at string, data array<struct<{_fields(RECORDS[kind])}>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return _records(docs.withColumn("symbol", symbol), position)


def parse_documents(texts: DataFrame, kind: str, position: bool = False) -> DataFrame:
    """The same from a ``(symbol, text)`` table, e.g. an object-store listing or a stream."""
    doc = F.from_json("text", wrapped(RECORDS[kind]))
    return _records(texts.select("symbol", doc.alias("d")).select("symbol", "d.*"), position)


def _records(docs: DataFrame, position: bool = False) -> DataFrame:
    """Bad documents have no data array and drop out here."""
    r = docs.select(F.col("symbol").alias("doc_symbol"), F.to_timestamp("_fetched_at").alias("fetched_at"), F.posexplode("data").alias("place", "r"))
    own = [f.name for f in docs.schema["data"].dataType.elementType.fields]
    order = [F.struct("fetched_at", "place").alias("load_order")] if position else []
    if "symbol" in own:
        return r.select("fetched_at", "r.*", *order)
    return r.select(F.col("doc_symbol").alias("symbol"), "fetched_at", *[F.col(f"r.{n}") for n in own], *order)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def map_prices(r: DataFrame) -> DataFrame:
    return r.select("symbol", "date", "open", "high", "low", "close", "volume", F.col("changePercent").alias("change_pct"), "vwap")


def map_income(r: DataFrame) -> DataFrame:
    return r.select(
        "symbol", "date", F.col("fiscalYear").alias("fiscal_year"), "period", "revenue", F.col("grossProfit").alias("gross_profit"),
        F.col("operatingIncome").alias("operating_income"), F.col("netIncome").alias("net_income"), "ebitda", "eps",
        F.col("epsDiluted").alias("eps_diluted"), F.col("weightedAverageShsOutDil").alias("shares_diluted"))


def map_balance(r: DataFrame) -> DataFrame:
    cash, debt = zero("cashAndCashEquivalents"), zero("shortTermDebt") + zero("longTermDebt")
    return r.select(
        "symbol", "date", F.col("fiscalYear").alias("fiscal_year"), "period", cash.alias("cash"), "inventory",
        F.col("totalCurrentAssets").alias("total_current_assets"), F.col("totalAssets").alias("total_assets"),
        F.col("totalCurrentLiabilities").alias("total_current_liabilities"), F.col("longTermDebt").alias("long_term_debt"),
        debt.alias("total_debt"), F.col("totalLiabilities").alias("total_liabilities"),
        F.col("totalStockholdersEquity").alias("total_equity"), (debt - cash).alias("net_debt"))


def map_cashflow(r: DataFrame) -> DataFrame:
    """Free cash flow only where both parts are known."""
    ocf, capex = F.col("netCashProvidedByOperatingActivities"), F.col("investmentsInPropertyPlantAndEquipment")
    return r.select(
        "symbol", "date", F.col("fiscalYear").alias("fiscal_year"), "period", ocf.alias("operating_cf"), capex.alias("capex"),
        (ocf + capex).alias("free_cash_flow"), F.col("commonDividendsPaid").alias("dividends_paid"),
        F.col("commonStockRepurchased").alias("stock_repurchased"))


def map_earnings(r: DataFrame) -> DataFrame:
    return r.select("symbol", "date", F.col("epsActual").alias("eps_actual"), F.col("epsEstimated").alias("eps_estimated"),
                    F.col("revenueActual").alias("revenue_actual"), F.col("revenueEstimated").alias("revenue_estimated"))


def map_insider_trades(r: DataFrame) -> DataFrame:
    shares, price = zero("securitiesTransacted"), zero("price")
    return r.select(
        "symbol", F.col("transactionDate").alias("transaction_date"), F.col("reportingName").alias("reporting_name"),
        F.col("typeOfOwner").alias("type_of_owner"), F.col("transactionType").alias("transaction_type"), shares.alias("shares"),
        price.alias("price"), (shares * price).alias("value"), F.col("securitiesOwned").alias("securities_owned"))


def map_analyst_grades(r: DataFrame) -> DataFrame:
    return r.select("symbol", "date", F.col("gradingCompany").alias("grading_company"), F.col("previousGrade").alias("previous_grade"),
                    F.col("newGrade").alias("new_grade"), "action")


def with_index_bars(prices: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Index bars joined to the price table under their symbol without the caret."""
    return prices.unionByName(index_bars.withColumn("symbol", F.regexp_replace("symbol", r"\^", "")), allowMissingColumns=True)


def pe_series(metrics: DataFrame) -> DataFrame:
    """Quarterly price-earnings from the earnings yield, profitable quarters only."""
    ok = metrics.filter(F.col("earningsYield") > 0)
    return ok.select("symbol", "date", (1.0 / F.col("earningsYield")).alias("pe"))


def map_index_changes(r: DataFrame, index_name: str) -> DataFrame:
    """Each swap becomes an ``added`` and a ``removed`` event."""
    both = F.array(
        F.struct(F.col("symbol").alias("symbol"), F.lit("added").alias("action"), F.col("removedTicker").alias("replaced")),
        F.struct(F.col("removedTicker").alias("symbol"), F.lit("removed").alias("action"), F.col("symbol").alias("replaced")))
    out = r.filter(F.col("date").isNotNull()).select(F.lit(index_name).alias("index_name"), F.col("date").alias("event_date"), "reason", F.explode(both).alias("e"))
    return out.select("index_name", "e.symbol", "event_date", "e.action", "e.replaced", "reason").filter(
        F.col("symbol").isNotNull() & (F.col("symbol") != ""))


def map_delisted(r: DataFrame, us_only: bool = True) -> DataFrame:
    out = r.filter(F.col("symbol").isNotNull())
    if us_only:
        out = out.filter(F.col("exchange").isin(list(US_EXCHANGES)))
    return out.select("symbol", F.col("companyName").alias("company_name"), "exchange", F.col("ipoDate").alias("ipo_date"), F.col("delistedDate").alias("delisted_date"))


def map_macro(observations: DataFrame, names: dict[str, str], source: str) -> DataFrame:
    """``(date, series_id, value text)`` → renamed numeric series; other text drops out."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = observations.withColumns({"series": table[F.col("series_id")], "value": F.col("value").try_cast("double")})
    return out.filter(F.col("series").isNotNull() & F.col("value").isNotNull()).select("date", "series", "value", F.lit(source).alias("source"))


def index_as_macro(bars: DataFrame, symbol: str, series: str = "spx", start=None) -> DataFrame:
    out = bars.filter((F.col("symbol") == symbol) & F.col("close").isNotNull())
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    return out.select("date", F.lit(series).alias("series"), F.col("close").alias("value"), F.lit("index").alias("source"))


RESULT = (
    "run_id string, strategy string, config struct<strategy_id:string,universe:struct<type:string,sector:string,symbols:array<string>>,"
    "entry:struct<trigger:struct<type:string,threshold:double,window_days:int>>,stop_loss:struct<value:double>,take_profit:struct<value:double>,"
    "sizing:struct<max_positions:int>,backtest:struct<start:string,end:string,slippage_bps:double>>,"
    "metrics struct<total_return_pct:double,annualized_return_pct:double,max_drawdown_pct:double,sharpe_ratio:double,win_rate_pct:double,profit_factor:double,total_trades:int,final_nav:double>,"
    "sleeves array<struct<label:string,trades:array<struct<date:date,action:string,symbol:string,shares:double,price:double,amount:double,reason:string,pnl:double>>>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored backtest results, one JSON document per file."""
    return spark.read.schema(RESULT).json(path, multiLine=True).withColumn(
        "run_id", F.coalesce("run_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)))


def parse_results(texts: DataFrame) -> DataFrame:
    fields = F.from_json("text", RESULT)
    return texts.select(fields.alias("d")).select("d.*")


def universe_detail(limit: int | None = None) -> Column:
    """The sector, or the symbols in their stored order (at most ``limit`` of them, if given)."""
    symbols = F.col("config.universe.symbols")
    kind = F.col("config.universe.type")
    return F.when(kind == "sector", F.coalesce("config.universe.sector", F.lit(""))).when(
        kind == "symbols", F.array_join(symbols if limit is None else F.slice(symbols, 1, limit), ",")).otherwise("all")


def run_metrics(results: DataFrame) -> DataFrame:
    """Flat row per stored result."""
    return results.select(
        "run_id", F.col("config.strategy_id").alias("strategy_id"), "strategy", F.coalesce("config.universe.type", F.lit("all")).alias("universe_type"),
        universe_detail().alias("universe_detail"), F.col("config.entry.trigger.type").alias("trigger_type"),
        F.col("config.entry.trigger.threshold").alias("trigger_threshold"), F.col("config.stop_loss.value").alias("stop_loss"),
        F.col("config.take_profit.value").alias("take_profit"), F.col("config.sizing.max_positions").alias("max_positions"),
        F.to_date("config.backtest.start").alias("start"), F.to_date("config.backtest.end").alias("end"), "metrics.*")


def result_trades(results: DataFrame, source_type: str = "backtest") -> DataFrame:
    """Ledger rows of stored results: sleeves, then trades."""
    s = results.select("run_id", F.explode("sleeves").alias("s"))
    t = s.select("run_id", F.col("s.label").alias("sleeve"), F.posexplode("s.trades").alias("n", "t"))
    ident = F.substring(F.md5(F.concat_ws(":", F.lit(source_type), "run_id", "sleeve", F.col("n").cast("string"), F.col("t.date").cast("string"), "t.symbol", "t.action")), 1, 12)
    return t.select(ident.alias("id"), F.lit(source_type).alias("source_type"), F.col("run_id").alias("source_id"), "sleeve", "t.*")
