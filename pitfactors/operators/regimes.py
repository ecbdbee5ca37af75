"""Regime labels from macro predicates, profiles and sleeve gates built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import compare
from pitfactors.operators import asof


@dataclass(frozen=True)
class Condition:
    series: str
    operator: str
    value: float


@dataclass(frozen=True)
class Regime:
    """Entry and exit rules; without exit rules a regime ends when its entry rule fails."""

    name: str
    entry: tuple[Condition, ...]
    entry_logic: str = "all"
    exit: tuple[Condition, ...] = ()
    exit_logic: str = "any"
    min_hold_days: int = 0
    entry_persistence: int = 1
    exit_persistence: int = 1


@dataclass(frozen=True)
class Profile:
    name: str
    trigger: tuple[str, ...]
    weights: Mapping[str, float]


def macro_wide(macro: DataFrame, dates: Column, series: Sequence[str]) -> DataFrame:
    """One row per date, one column per series, each as of the date."""
    names = F.explode(F.array(*[F.lit(s) for s in series]))
    base = macro.filter(F.col("series").isin(list(series))).select("date", "series", "value")
    grid = base.agg(F.lit(1).alias("x")).select(F.explode(dates).alias("date")).withColumn("series", names)
    held = asof.backward(grid, base, on="series", cols=["value"])
    return held.groupBy("date").agg(*[F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series])


def met(c: Condition) -> Column:
    """A missing value does not meet a condition."""
    return F.coalesce(compare(F.col(f"`{c.series}`"), c.operator, c.value), F.lit(False))


def all_or_any(conditions: Sequence[Condition], logic: str) -> Column:
    if not conditions:
        return F.lit(False)
    if logic not in ("all", "any"):
        raise ValueError(f"unknown logic {logic!r}")
    tests = [met(c) for c in conditions]
    return reduce(lambda a, b: a & b, tests) if logic == "all" else reduce(lambda a, b: a | b, tests)


def entry_rule(r: Regime) -> Column:
    return all_or_any(r.entry, r.entry_logic)


def exit_rule(r: Regime) -> Column:
    return all_or_any(r.exit, r.exit_logic) if r.exit else ~entry_rule(r)


def stateless(wide: DataFrame, regimes: Sequence[Regime]) -> DataFrame:
    """``(date, regime, active)`` from the entry rules alone."""
    flags = F.array(*[F.struct(F.lit(r.name).alias("regime"), entry_rule(r).alias("active")) for r in regimes])
    return wide.select("date", F.inline(flags))


def rule_flags(wide: DataFrame, regimes: Sequence[Regime]) -> DataFrame:
    """``(date, regime, entry, leave, …parameters)``: input of the state machine."""
    rows = [F.struct(
        F.lit(r.name).alias("regime"), entry_rule(r).alias("entry"), exit_rule(r).alias("leave"),
        F.lit(r.min_hold_days).alias("hold"), F.lit(max(1, r.entry_persistence)).alias("need_in"),
        F.lit(max(1, r.exit_persistence)).alias("need_out")) for r in regimes]
    return wide.select("date", F.inline(F.array(*rows)))


STATE_SCHEMA = "regime string, date date, entry boolean, active boolean, activated boolean, deactivated boolean, filtered boolean"


def step(state: tuple[int, int, int], entry: bool, leave: bool, hold: int, need_in: int, need_out: int):
    """One day of the machine.

    State is ``(phase, run, days)``: phase 0 off, 1 minimum hold, 2 watching the exit;
    ``run`` counts the rule in a row, ``days`` the days since activation.
    Returns the new state and ``(active, activated, deactivated, filtered)``.
    """
    phase, run, days = state
    if phase == 0:
        filtered = not entry and run > 0
        run = run + 1 if entry else 0
        if run >= need_in:
            return (1 if hold > 0 else 2, 0, 0), (True, True, False, False)
        return (0, run, 0), (False, False, False, filtered)
    days += 1
    if phase == 1:
        return (2 if days >= hold else 1, 0, days), (True, False, False, False)
    run = run + 1 if leave else 0
    if run >= need_out:
        return (0, 0, 0), (False, False, True, False)
    return (2, run, days), (True, False, False, False)


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date")
    state, out = (0, 0, 0), []
    for row in pdf.itertuples(index=False):
        state, flags = step(state, row.entry, row.leave, row.hold, row.need_in, row.need_out)
        out.append(flags)
    flags = np.array(out, dtype=bool).reshape(-1, 4)
    result = pdf[["regime", "date", "entry"]].copy()
    for i, name in enumerate(("active", "activated", "deactivated", "filtered")):
        result[name] = flags[:, i]
    return result


def stateful(wide: DataFrame, regimes: Sequence[Regime]) -> DataFrame:
    """Regime states with minimum hold and persistence; one group per regime, bounded by the calendar."""
    return rule_flags(wide, regimes).groupBy("regime").applyInPandas(_walk, schema=STATE_SCHEMA)


def carried(flags: DataFrame) -> DataFrame:
    """``(regime, phase, run, days, seen)``: the machine's state after the last day of ``rule_flags``, for a stream to go on from."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = (0, 0, 0)
        for row in pdf.sort_values("date").itertuples(index=False):
            state, _ = step(state, row.entry, row.leave, row.hold, row.need_in, row.need_out)
        return pd.DataFrame([(pdf["regime"].iloc[0], *state, pdf["date"].max())], columns=["regime", "phase", "run", "days", "seen"])

    return flags.groupBy("regime").applyInPandas(run, schema="regime string, phase int, run int, days int, seen date")


def persistence_stats(states: DataFrame) -> DataFrame:
    return states.groupBy("regime").agg(
        F.count_if("entry").alias("raw_entry_met_days"), F.count_if("active").alias("active_days"), F.count_if("activated").alias("n_activations"),
        F.count_if("deactivated").alias("n_deactivations"), F.count_if("filtered").alias("filtered_short_entry_runs"))


def breakdown(wide: DataFrame, regimes: Sequence[Regime]) -> DataFrame:
    """Per date and regime: every entry condition with its actual value and result."""
    rows = [F.struct(F.lit(r.name).alias("regime"), F.array(*[F.struct(
        F.lit(c.series).alias("series"), F.lit(c.operator).alias("operator"), F.lit(float(c.value)).alias("threshold"),
        F.col(f"`{c.series}`").alias("actual"), met(c).alias("met")) for c in r.entry]).alias("conditions")) for r in regimes]
    return wide.select("date", F.inline(F.array(*rows)))


def transitions(states: DataFrame) -> DataFrame:
    """Dates on which a regime switches; the first date counts when it is already active."""
    w = Window.partitionBy("regime").orderBy("date")
    prev = F.coalesce(F.lag("active").over(w), F.lit(False))
    return states.select("regime", "date", "active", prev.alias("prev")).filter(F.col("active") != F.col("prev")).select(
        "regime", "date", F.when(F.col("active"), "activated").otherwise("deactivated").alias("event"))


def active_lists(states: DataFrame) -> DataFrame:
    """``(date, active)``: sorted names of the active regimes."""
    return states.groupBy("date").agg(F.sort_array(F.collect_list(F.when(F.col("active"), F.col("regime")))).alias("active"))


def resolve_profile(active: DataFrame, profiles: Sequence[Profile], default: Profile | None = None) -> DataFrame:
    """First profile whose trigger regimes are all active, else the default."""
    hit = None
    for p in profiles:
        if not p.trigger:
            continue
        ok = F.size(F.array_except(F.array(*[F.lit(t) for t in p.trigger]), F.col("active"))) == 0
        hit = F.when(ok, F.lit(p.name)) if hit is None else hit.when(ok, F.lit(p.name))
    other = F.lit(default.name if default else None)
    return active.withColumn("profile", other if hit is None else hit.otherwise(other))


def allocations(resolved: DataFrame, profiles: Sequence[Profile], sleeves: Sequence[str]) -> DataFrame:
    """Weight per date and sleeve, with the remainder as ``Cash``."""
    table = F.create_map(*[x for p in profiles for x in (F.lit(p.name), F.array(
        *[F.struct(F.lit(s).alias("sleeve"), F.lit(float(p.weights.get(s, 0.0))).alias("weight")) for s in sleeves],
        F.struct(F.lit("Cash").alias("sleeve"), F.lit(max(0.0, round(1.0 - sum(p.weights.get(s, 0.0) for s in sleeves), 6))).alias("weight"))))])
    return resolved.filter(F.col("profile").isNotNull()).select("date", "profile", F.inline(table[F.col("profile")]))


def change_points(resolved: DataFrame) -> DataFrame:
    """Rows where the profile differs from the day before (the first row included)."""
    w = Window.orderBy("date")  # one row per date
    out = resolved.withColumn("from_profile", F.lag("profile").over(w))
    return out.filter(~F.col("profile").eqNullSafe(F.col("from_profile"))).select("date", "profile", "from_profile")


def sleeve_gate(active: DataFrame, weights: DataFrame, gates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Dates on which a sleeve may trade: a gate regime is active and its weight is positive."""
    rows = F.array(*[F.struct(F.lit(s).alias("sleeve"), F.array(*[F.lit(g) for g in names]).cast("array<string>").alias("gate")) for s, names in gates.items()])
    opened = active.select("date", "active", F.inline(rows)).filter(
        (F.size("gate") == 0) | F.array_contains("gate", "*") | F.arrays_overlap("gate", "active"))
    return opened.join(weights.filter(F.col("weight") > 0).select("date", "sleeve"), ["date", "sleeve"]).select("date", "sleeve")


def smooth_weights(weights: DataFrame, resolved: DataFrame, to_defensive: int, to_offensive: int) -> DataFrame:
    """Linear transition after each profile flip; the length depends on its direction.

    Built for flips that do not overlap: every transition starts from the full weights of
    the profile before.
    """
    w = Window.orderBy("date")  # one row per date
    flips = resolved.filter(F.col("profile").isNotNull()).withColumn("_prev", F.lag("profile").over(w))
    new = (F.col("_prev").isNotNull() & (F.col("_prev") != F.col("profile"))).cast("int")
    flips = flips.withColumn("_id", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("_id").orderBy("date")
    flips = flips.select(
        "date", "profile", "_id", F.first("_prev").over(inside).alias("from_profile"), (F.row_number().over(inside) - 1).alias("elapsed"))
    per_profile = weights.filter(F.col("sleeve") != "Cash").select("profile", "sleeve", "weight").distinct()
    equity = per_profile.groupBy("profile").agg(F.sum("weight").alias("equity"))
    before = per_profile.select(F.col("profile").alias("from_profile"), "sleeve", F.col("weight").alias("from_weight"))
    eq_before = equity.select(F.col("profile").alias("from_profile"), F.col("equity").alias("from_equity"))
    j = flips.join(per_profile, "profile").join(before, ["from_profile", "sleeve"], "left").join(equity, "profile").join(eq_before, "from_profile", "left")
    days = F.when(F.col("equity") < F.col("from_equity"), to_defensive).otherwise(to_offensive)
    progress = F.when((F.col("_id") == 0) | (days <= 1), 1.0).otherwise(F.least(F.lit(1.0), F.col("elapsed") / days))
    start = F.coalesce("from_weight", F.col("weight"))
    return j.select("date", "sleeve", "profile", (start + (F.col("weight") - start) * progress).alias("weight"))


def smoothing_summary(resolved: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts of transitions by direction."""
    equity = weights.filter(F.col("sleeve") != "Cash").select("profile", "sleeve", "weight").distinct().groupBy("profile").agg(F.sum("weight").alias("e"))
    c = change_points(resolved).join(equity, "profile").join(
        equity.select(F.col("profile").alias("from_profile"), F.col("e").alias("e0")), "from_profile", "left")
    return c.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("e") < F.col("e0")).alias("n_defensive"),
        F.count_if(F.col("e") > F.col("e0")).alias("n_offensive"), F.count_if(F.col("e") == F.col("e0")).alias("n_lateral"))
