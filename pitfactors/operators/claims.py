"""Validation of factor claims: conditional double sorts, regime panels, verdicts, folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions import ranks
from pitfactors.functions.columns import ratio
from pitfactors.operators import calendars

# Fixed values of the claim vocabulary.
VALIDATED = ("unconditional", "validated", "regime_reversing", "validated_conditional")
HYPOTHESES = ("cheap_beats_expensive", "expensive_beats_cheap")
SIGNIFICANT, FLAT, MIN_DATES = 1.5, 0.5, 8


def double_sort(panel: DataFrame, by: Sequence[str] = ("date",), primary: str = "primary", conditioning: str = "conditioning", label: str = "fwd", min_names: int = 25, min_top: int = 10, seed: int | None = None) -> DataFrame:
    """Cheapest minus dearest fifth by ``conditioning`` inside the top fifth by ``primary``.

    With ``seed`` the second sort is a reproducible shuffle: the control a real effect
    must beat.
    """
    by = list(by)
    ok = panel.filter(F.col(primary).isNotNull() & F.col(conditioning).isNotNull())
    strategy = ranks.plan(ok, by)
    first = ranks.ordinal(ok, by, [primary, "symbol"], "_r1", "_n", descending=True, strategy=strategy).filter(F.col("_n") >= min_names)
    top = F.greatest(F.floor(F.col("_n") * 0.2), F.lit(5))
    kept = first.filter((F.col("_r1") <= top) & (top >= min_top))
    order = conditioning
    if seed is not None:
        kept = kept.withColumn("_mix", F.xxhash64(F.lit(seed), *by, F.col("symbol")))
        order = "_mix"
    second = ranks.ordinal(kept, by, [order, "symbol"], "_r2", "_k", strategy=strategy)
    m = F.greatest(F.floor(F.col("_k") / 5), F.lit(1))
    cheap, dear = F.col("_r2") <= m, F.col("_r2") > F.col("_k") - m
    out = second.groupBy(*by).agg((F.avg(F.when(cheap, F.col(label))) - F.avg(F.when(dear, F.col(label)))).alias("spread"))
    return out.filter(F.col("spread").isNotNull())


def _summary(horizon: int) -> list[Column]:
    year = 252.0 / horizon
    n, mu, sd = F.count("spread"), F.avg("spread"), F.stddev_pop("spread")
    t = F.coalesce(ratio(mu, sd / F.sqrt(n)), F.lit(0.0))
    return [n.alias("n"), (mu * year * 100).alias("mean_ann_pct"), F.when(n > 1, t).otherwise(0.0).alias("t_stat"),
            F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate")]


def by_regime(spreads: DataFrame, labels: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Summary per active regime, ``neutral`` where none is active, and ``__overall__``.

    ``labels`` is ``(date, active array)``.
    """
    by = list(by)
    j = spreads.join(labels.select("date", "active"), "date", "left")
    own = F.when(F.coalesce(F.size("active"), F.lit(0)) > 0, F.col("active")).otherwise(F.array(F.lit("neutral")))
    rows = j.withColumn("regime", F.explode(F.concat(own, F.array(F.lit("__overall__")))))
    return rows.groupBy(*by, "regime").agg(*_summary(horizon))


def by_window(spreads: DataFrame, windows: list[tuple], horizon: int, train: tuple | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Summary per evaluation window; a window is out of sample when it is disjoint from ``train``."""
    out = calendars.in_windows(spreads, windows).groupBy(*by, "label", "start", "end").agg(*_summary(horizon))
    if train is None:
        return out.withColumn("is_oos", F.lit(False))
    ts, te = (F.lit(x).cast("date") for x in train)
    return out.withColumn("is_oos", ~((F.col("start") <= te) & (ts <= F.col("end"))))


def verdicts(per_regime: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Status from the regime panel: unconditional, reversing, conditional or rejected."""
    by = list(by)
    pooled = F.col("regime") == "__overall__"
    big = ~pooled & (F.col("n") >= MIN_DATES)
    t, mean = F.col("t_stat"), F.col("mean_ann_pct")
    g = per_regime.groupBy(*by) if by else per_regime.groupBy()
    base = g.agg(
        F.count_if(big & (t >= SIGNIFICANT)).alias("holds"), F.count_if(big & (t <= -SIGNIFICANT)).alias("reverses"),
        F.max(F.when(pooled, t)).alias("overall_t"), F.max(F.when(pooled, mean)).alias("overall_mean"),
        F.count_if(big & (mean >= 0)).alias("_up"), F.count_if(big & (mean < 0)).alias("_down"), F.count_if(big & (F.abs(t) < FLAT)).alias("_flat"))
    against = F.when(F.coalesce(F.col("overall_mean"), F.lit(0.0)) >= 0, F.col("_down")).otherwise(F.col("_up")) + F.col("_flat")
    strong = F.abs(F.coalesce("overall_t", F.lit(0.0))) >= SIGNIFICANT
    status = (
        F.when((F.col("holds") > 0) & (F.col("reverses") > 0), "regime_reversing")
        .when(strong & (F.col("holds") > 0), F.when(against == 0, "unconditional").otherwise("validated_conditional"))
        .when((F.col("holds") > 0) | (F.col("reverses") > 0), "validated_conditional")
        .otherwise("rejected"))
    confidence = F.when(status == "unconditional", "high").when(status == "rejected", "low").otherwise("medium")
    return base.select(*by, "holds", "reverses", "overall_t", "overall_mean", status.alias("status"), confidence.alias("confidence"))


def oos_persistence(per_window: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many out-of-sample windows show an effect."""
    g = per_window.groupBy(*by) if by else per_window.groupBy()
    return g.agg(F.count_if("is_oos").alias("n_oos"), F.count_if(F.col("is_oos") & (F.abs("t_stat") >= SIGNIFICANT)).alias("n_hold"))


def regime_gate(states: DataFrame, calendar: DataFrame, market: DataFrame, horizon: int = 21, min_episodes: int = 3, min_days: int = 60) -> DataFrame:
    """Whether a regime recurs and separates forward market returns.

    ``states`` is ``(regime, date, active)``, ``calendar`` ``(date, idx)``, ``market``
    ``(date, close)``.  A gap of more than five rows starts a new episode.
    """
    w = Window.partitionBy("regime").orderBy("idx")
    active = states.filter("active").join(calendar, "date")
    prev = F.lag("idx").over(w)
    episodes = active.withColumn("_new", (prev.isNull() | (F.col("idx") - prev > 5)).cast("int")).groupBy("regime").agg(
        F.sum("_new").alias("episodes"), F.count(F.lit(1)).alias("active_days"))
    m = market.join(calendar, "date").select("date", "idx", "close")
    later = m.select((F.col("idx") - horizon).alias("idx"), F.col("close").alias("_f"))
    fwd = m.join(later, "idx").filter(F.col("close") > 0).select("date", (F.col("_f") / F.col("close") - 1).alias("fwd"))
    on = F.col("active")
    s = states.join(fwd, "date").groupBy("regime").agg(
        F.count_if(on).alias("n_in"), F.count_if(~on).alias("n_out"), F.avg(F.when(on, F.col("fwd"))).alias("_mi"),
        F.avg(F.when(~on, F.col("fwd"))).alias("_mo"), F.var_pop(F.when(on, F.col("fwd"))).alias("_vi"), F.var_pop(F.when(~on, F.col("fwd"))).alias("_vo"))
    diff = F.col("_mi") - F.col("_mo")
    t = F.coalesce(ratio(diff, F.sqrt(F.col("_vi") / F.col("n_in") + F.col("_vo") / F.col("n_out"))), F.lit(0.0))
    j = s.filter((F.col("n_in") > 0) & (F.col("n_out") > 0)).withColumn("t_stat", t).join(episodes, "regime")
    recurs = (F.col("episodes") >= min_episodes) & (F.col("active_days") >= min_days)
    enough = (F.col("n_in") >= 20) & (F.col("n_out") >= 20)
    reason = F.when(~recurs, "insufficient recurrence").when(~enough, "too few observations").when(
        F.abs("t_stat") >= SIGNIFICANT, "recurring and conditioning").otherwise("no conditioning power")
    return j.select("regime", "episodes", "active_days", (diff * 100).alias("diff_pct"), "t_stat",
                    F.when(reason == "recurring and conditioning", "validated").otherwise("rejected").alias("status"), reason.alias("reason"))


# ---------------------------------------------------------------- claim specs

SPEC = "primary_factor string, primary_bucket string, conditioning_factor string, horizon_days int, hypothesis string"


def usable_specs(claims: DataFrame, known_factors: DataFrame) -> DataFrame:
    """Claims whose specification can be tested; others are dropped.

    Two distinct known factors, a positive whole horizon and an allowed hypothesis.
    ``known_factors`` is ``(factor)``.
    """
    s = claims.withColumn("spec", F.from_json("test_spec", SPEC))
    ok = s.filter(
        (F.col("spec.primary_factor") != F.col("spec.conditioning_factor")) & (F.col("spec.horizon_days") > 0)
        & F.col("spec.hypothesis").isin(list(HYPOTHESES)))
    for col in ("primary_factor", "conditioning_factor"):
        known = known_factors.select(F.col("factor").alias(col))
        ok = ok.withColumn(col, F.col(f"spec.{col}")).join(known, col, "left_semi")
    return ok.withColumns({"horizon_days": F.col("spec.horizon_days"), "hypothesis": F.col("spec.hypothesis")}).drop("spec")


def canonical_spec(spec: Column | str) -> Column:
    """Specification with sorted keys, so equal content gives equal text."""
    m = F.from_json(spec, "map<string,string>")
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.trim(spec))


def claim_id(universe: str, canon: str) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(universe, F.lit("")), F.lit("|"), F.col(canon))), 1, 16)


def _identified(claims: DataFrame) -> DataFrame:
    c = claims.filter(F.col("test_spec").isNotNull()).withColumn("canon", canonical_spec("test_spec"))
    return c.withColumn("claim_id", claim_id("universe", "canon"))


def _regime_texts(identified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct regime conditions per key, sorted.

    Copies of a claim collapse in a map-side ``distinct`` before anything is collected.
    """
    parts = identified.select(*keys, F.explode(F.split("regime_conditions", ";")).alias("_r")).select(*keys, F.trim("_r").alias("_r"))
    return parts.distinct().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_r")), "; ").alias("regime_conditions"))


def run_level(claims: DataFrame) -> DataFrame:
    """One row per run and claim with the most informative status of the run."""
    order = F.array(*[F.lit(s) for s in (*VALIDATED, "rejected", "candidate")])
    place = F.array_position(order, F.coalesce("status", F.lit("candidate")))
    place = F.when(place == 0, F.lit(len(VALIDATED) + 2)).otherwise(place)
    return _identified(claims).groupBy("run", "claim_id", "universe", "canon").agg(
        F.element_at(order, F.min(place).cast("int")).alias("run_status"), F.count(F.lit(1)).alias("n_items"))


def fold_claims(claims: DataFrame) -> DataFrame:
    """Claim library over runs: repetitions, verdict counts, merged regimes, sign conflict.

    Folding a run again changes nothing, because runs are grouped, not added up.
    """
    out = run_level(claims).groupBy("claim_id", "universe", "canon").agg(
        F.count(F.lit(1)).alias("repetition_count"), F.count_if(F.col("run_status").isin(list(VALIDATED))).alias("times_validated"),
        F.count_if(F.col("run_status") == "rejected").alias("times_rejected"), F.max_by("run_status", "run").alias("latest_status"))
    out = out.join(_regime_texts(_identified(claims), ["claim_id"]), "claim_id", "left").fillna("", ["regime_conditions"])
    low = F.lower("regime_conditions")
    return out.withColumn("has_conflict", low.contains("holds in") & low.contains("reverses"))


def run_report(claims: DataFrame) -> DataFrame:
    """Counts per run: items, distinct specs, validated, rejected."""
    return run_level(claims).groupBy("run").agg(
        F.sum("n_items").alias("n_items"), F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("run_status").isin(list(VALIDATED))).alias("n_validated"), F.count_if(F.col("run_status") == "rejected").alias("n_rejected"))


def validate(claims: DataFrame, long: DataFrame, labels: DataFrame, known_factors: DataFrame, min_names: int = 25, min_top: int = 10) -> DataFrame:
    """Verdict per claim: every claim's double sort runs in one job, keyed by the claim's spec.

    ``long`` is ``(symbol, date, feature, value, fwd, horizon)``.
    """
    ok = usable_specs(claims, known_factors)
    specs = ok.select("primary_factor", "conditioning_factor", "horizon_days").distinct()
    a = long.select("symbol", "date", "fwd", F.col("horizon").alias("horizon_days"), F.col("feature").alias("primary_factor"), F.col("value").alias("primary"))
    b = long.select("symbol", "date", F.col("horizon").alias("horizon_days"), F.col("feature").alias("conditioning_factor"), F.col("value").alias("conditioning"))
    rows = a.join(specs, ["primary_factor", "horizon_days"]).join(b, ["symbol", "date", "horizon_days", "conditioning_factor"])
    keys = ["primary_factor", "conditioning_factor", "horizon_days"]
    spread = double_sort(rows, [*keys, "date"], min_names=min_names, min_top=min_top)
    # The annual scale depends on the horizon, so the mean is scaled after the summary.
    per = by_regime(spread, labels, 252, keys).withColumn("mean_ann_pct", F.col("mean_ann_pct") * 252.0 / F.col("horizon_days"))
    v = verdicts(per, keys)
    return ok.select("id", *keys).join(v, keys, "left").select("id", *keys, F.coalesce("status", F.lit("rejected")).alias("status"), "holds", "reverses", "overall_t")
