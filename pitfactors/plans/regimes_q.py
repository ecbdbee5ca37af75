"""Macro series and regimes over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import calendars
from pitfactors.operators import macro as M
from pitfactors.operators import regimes as R
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

U, H, L = "1-URGENT", "2-HIGH", "5-LOW"
SER = "PARTITION BY series ORDER BY date"
MA = f"SELECT date, 'ma50' AS series, v AS value FROM (SELECT date, avg(value) OVER w AS v, count(*) OVER w AS k FROM macro WHERE series = '{U}' WINDOW w AS ({SER} ROWS 49 PRECEDING)) WHERE k = 50"
VS = f"SELECT m.date, 'vs50' AS series, (m.value - a.value) / a.value * 100 AS value FROM macro m JOIN ({MA}) a USING (date) WHERE m.series = '{U}'"
YOY = f"SELECT a.date, 'yoy' AS series, (a.value - b.value) / b.value * 100 AS value FROM macro a JOIN macro b ON a.series = b.series AND month(a.date) = month(b.date) AND day(a.date) = day(b.date) AND year(a.date) = year(b.date) + 1 WHERE a.series = '{U}' AND NOT (month(a.date) = 2 AND day(a.date) = 29)"
MOM = f"SELECT * FROM (SELECT date, 'mom' AS series, (value - lag(value) OVER w) / lag(value) OVER w * 100 AS value FROM macro WHERE series = '{U}' WINDOW w AS ({SER})) WHERE value IS NOT NULL"
SPREAD = f"SELECT date, 'spread' AS series, a.value - b.value AS value FROM macro a JOIN macro b USING (date) WHERE a.series = '{U}' AND b.series = '{H}'"
RATIO = f"SELECT date, 'ratio' AS series, a.value / b.value AS value FROM macro a JOIN macro b USING (date) WHERE a.series = '{U}' AND b.series = '{H}'"
ZS = f"SELECT date, 'z60' AS series, (value - m) / s AS value FROM (SELECT date, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS k FROM macro WHERE series = '{L}' WINDOW w AS ({SER} ROWS 59 PRECEDING)) WHERE k = 60 AND s > 0"
REAL = f"SELECT d.date, 'real' AS series, d.value - m.v AS value FROM macro d JOIN (SELECT year(date) AS y, month(date) AS mo, arg_max(value, date) AS v FROM ({YOY}) GROUP BY 1, 2) m ON m.y = year(d.date) AND m.mo = month(d.date) WHERE d.series = '{L}'"
PLAN = [("ma", U, 50, "ma50"), ("vs_ma", U, 50, "vs50"), ("yoy", U, "yoy"), ("mom", U, "mom"), ("spread", U, H, "spread"), ("ratio", U, H, "ratio"), ("zscore", L, 60, "z60")]

for _i, (_sql, _spec) in enumerate(zip([MA, VS, YOY, MOM, SPREAD, RATIO, ZS], PLAN), 1):
    @query(f"m{_i:02d}_{_spec[-1]}", _sql, "value:5")
    def run(spark, sf, spec=_spec):
        return M.derive(A.macro(spark, sf), [spec])


@query("m08_real_rate", REAL, "value:5")
def m08(spark, sf):
    m = A.macro(spark, sf)
    return M.real_rate(m, L, M.year_on_year(m, U, "yoy"), "real")


@query("m09_derive_all", " UNION ALL ".join(f"SELECT * FROM ({s})" for s in (MA, VS, YOY, MOM, SPREAD, RATIO, ZS)), "value:5")
def m09(spark, sf):
    return M.derive(A.macro(spark, sf), PLAN)


@query("m10_quality_issues",
       f"""SELECT 'missing' AS issue, s.series, NULL::DATE AS date, NULL::DOUBLE AS detail FROM (SELECT DISTINCT 'sym:' || p_brand AS series FROM part WHERE p_size = 1 UNION SELECT DISTINCT series FROM macro) s WHERE s.series NOT IN (SELECT series FROM macro)
  UNION ALL SELECT 'gap', series, date, CAST(g AS DOUBLE) FROM (SELECT series, date, date - lag(date) OVER ({SER}) AS g FROM macro) WHERE g > 5
  UNION ALL SELECT 'range', series, date, value FROM macro WHERE series = '{U}' AND (value < 50000 OR value > 450000)""", "detail")
def m10(spark, sf):
    m = A.macro(spark, sf)
    names = A.table(spark, sf, "part").filter("p_size = 1").select(F.concat(F.lit("sym:"), "p_brand").alias("series")).union(m.select("series"))
    return M.quality_issues(m, names, 5, {U: (50000, 450000)})


# ---------------------------------------------------------------- regimes

CALM = R.Regime("calm", (R.Condition(U, "<", 250000.0), R.Condition(H, "<", 260000.0)), "all")
HOT = R.Regime("hot", (R.Condition(U, ">", 270000.0), R.Condition(L, ">", 290000.0)), "any", (R.Condition(U, "<", 240000.0),), "any", 5, 2, 2)
RS = [CALM, HOT]
LO, HI = 250000.0, 260000.0


def wide(spark, sf):
    return R.macro_wide(A.macro(spark, sf), calendars.date_array(A.dates(spark, sf)), [U, H, L])


RV = {
    "mw": f"""SELECT c.date, u.value AS u, h.value AS h, l.value AS l FROM calendar c ASOF LEFT JOIN (SELECT * FROM macro WHERE series = '{U}') u ON c.date >= u.date
  ASOF LEFT JOIN (SELECT * FROM macro WHERE series = '{H}') h ON c.date >= h.date ASOF LEFT JOIN (SELECT * FROM macro WHERE series = '{L}') l ON c.date >= l.date""",
    "fl": """SELECT date, 'calm' AS regime, coalesce(u < 250000 AND h < 260000, FALSE) AS e, NOT coalesce(u < 250000 AND h < 260000, FALSE) AS x, 0 AS hold, 1 AS ni, 1 AS no FROM mw
  UNION ALL SELECT date, 'hot', coalesce(u > 270000, FALSE) OR coalesce(l > 290000, FALSE), coalesce(u < 240000, FALSE), 5, 2, 2 FROM mw""",
    "fr": "SELECT *, row_number() OVER (PARTITION BY regime ORDER BY date) AS rn FROM fl",
    # p: 0 off, 1 minimum hold, 2 watching; r: rule run; d: days since activation
    "st": """SELECT regime, CAST(0 AS BIGINT) AS rn, 0 AS p, 0 AS r, 0 AS d, FALSE AS active, FALSE AS up, FALSE AS down, FALSE AS filt FROM (SELECT DISTINCT regime FROM fr)
  UNION ALL SELECT f.regime, f.rn,
   CASE WHEN s.p = 0 THEN CASE WHEN f.e AND s.r + 1 >= f.ni THEN CASE WHEN f.hold > 0 THEN 1 ELSE 2 END ELSE 0 END
        WHEN s.p = 1 THEN CASE WHEN s.d + 1 >= f.hold THEN 2 ELSE 1 END
        ELSE CASE WHEN f.x AND s.r + 1 >= f.no THEN 0 ELSE 2 END END,
   CASE WHEN s.p = 0 THEN CASE WHEN f.e AND s.r + 1 < f.ni THEN s.r + 1 ELSE 0 END WHEN s.p = 1 THEN 0 ELSE CASE WHEN f.x AND s.r + 1 < f.no THEN s.r + 1 ELSE 0 END END,
   CASE WHEN s.p = 0 THEN 0 ELSE s.d + 1 END,
   CASE WHEN s.p = 0 THEN f.e AND s.r + 1 >= f.ni WHEN s.p = 1 THEN TRUE ELSE NOT (f.x AND s.r + 1 >= f.no) END,
   s.p = 0 AND f.e AND s.r + 1 >= f.ni, s.p = 2 AND f.x AND s.r + 1 >= f.no, s.p = 0 AND NOT f.e AND s.r > 0
  FROM st s JOIN fr f ON f.regime = s.regime AND f.rn = s.rn + 1""",
    "rs": "SELECT f.regime, f.date, f.e AS entry, s.active, s.up AS activated, s.down AS deactivated, s.filt AS filtered FROM st s JOIN fr f USING (regime, rn)",
    "act": "SELECT date, coalesce(list_sort(list(regime) FILTER (WHERE active)), []) AS active FROM rs GROUP BY 1",
    "prof": "SELECT date, active, CASE WHEN list_contains(active, 'hot') THEN 'defend' WHEN list_contains(active, 'calm') THEN 'attack' ELSE 'base' END AS profile FROM act",
    "pw": "SELECT * FROM (VALUES ('defend', 'a', 0.2::DOUBLE), ('defend', 'b', 0.3), ('attack', 'a', 0.7), ('attack', 'b', 0.3), ('base', 'a', 0.5), ('base', 'b', 0.0)) t(profile, sleeve, weight)",
}
RV["pwc"] = "SELECT * FROM pw UNION ALL SELECT profile, 'Cash', greatest(0, floor((1 - sum(weight)) * 1e6 + 0.5) / 1e6) FROM pw GROUP BY 1"
RV["flips"] = """SELECT date, profile, id, first_value(prev) OVER w AS from_profile, row_number() OVER w - 1 AS elapsed FROM (SELECT date, profile, prev, sum(CASE WHEN prev IS NOT NULL AND prev <> profile THEN 1 ELSE 0 END) OVER (ORDER BY date) AS id
   FROM (SELECT date, profile, lag(profile) OVER (ORDER BY date) AS prev FROM prof)) WINDOW w AS (PARTITION BY id ORDER BY date)"""
PROFILES = [R.Profile("defend", ("hot",), {"a": 0.2, "b": 0.3}), R.Profile("attack", ("calm",), {"a": 0.7, "b": 0.3})]
DEFAULT = R.Profile("base", (), {"a": 0.5})
ALL = [*PROFILES, DEFAULT]


@query("r01_predicate", "SELECT date, coalesce(u < 250000 AND h < 260000, FALSE) AS all_met, coalesce(u > 270000, FALSE) OR coalesce(l > 290000, FALSE) AS any_met, FALSE AS none FROM mw", views=RV)
def r01(spark, sf):
    return wide(spark, sf).select("date", R.entry_rule(CALM).alias("all_met"), R.entry_rule(HOT).alias("any_met"), R.all_or_any([], "all").alias("none"))


@query("r02_stateless", "SELECT date, regime, e AS active FROM fl", views=RV)
def r02(spark, sf):
    return R.stateless(wide(spark, sf), RS)


@query("r03_stateful", "SELECT * FROM rs", views=RV)
def r03(spark, sf):
    return R.stateful(wide(spark, sf), RS)


@query("r04_persistence_stats", "SELECT regime, count(*) FILTER (WHERE entry) AS raw_entry_met_days, count(*) FILTER (WHERE active) AS active_days, count(*) FILTER (WHERE activated) AS n_activations, count(*) FILTER (WHERE deactivated) AS n_deactivations, count(*) FILTER (WHERE filtered) AS filtered_short_entry_runs FROM rs GROUP BY 1", views=RV)
def r04(spark, sf):
    return R.persistence_stats(R.stateful(wide(spark, sf), RS))


@query("r05_breakdown",
       f"""SELECT date, 'calm' AS regime, '{U}' AS series, '<' AS operator, 250000.0::DOUBLE AS threshold, u AS actual, coalesce(u < 250000, FALSE) AS met FROM mw UNION ALL SELECT date, 'calm', '{H}', '<', 260000.0, h, coalesce(h < 260000, FALSE) FROM mw
  UNION ALL SELECT date, 'hot', '{U}', '>', 270000.0, u, coalesce(u > 270000, FALSE) FROM mw UNION ALL SELECT date, 'hot', '{L}', '>', 290000.0, l, coalesce(l > 290000, FALSE) FROM mw""", "threshold actual", RV)
def r05(spark, sf):
    return R.breakdown(wide(spark, sf), RS).select("date", "regime", F.inline("conditions"))


@query("r06_transitions", "SELECT regime, date, CASE WHEN active THEN 'activated' ELSE 'deactivated' END AS event FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY regime ORDER BY date), FALSE) AS p FROM rs) WHERE active <> p", views=RV)
def r06(spark, sf):
    return R.transitions(R.stateful(wide(spark, sf), RS))


def resolved(spark, sf):
    return R.resolve_profile(R.active_lists(R.stateful(wide(spark, sf), RS)), PROFILES, DEFAULT)


@query("r07_profile", "SELECT date, array_to_string(active, ',') AS active, profile FROM prof", views=RV)
def r07(spark, sf):
    return resolved(spark, sf).withColumn("active", F.array_join("active", ","))


@query("r08_sleeve_gate", "SELECT p.date, w.sleeve FROM prof p JOIN pw w USING (profile) WHERE w.weight > 0 AND (w.sleeve = 'a' OR list_contains(p.active, 'hot') OR list_contains(p.active, 'calm'))", views=RV)
def r08(spark, sf):
    r = resolved(spark, sf)
    return R.sleeve_gate(r.select("date", "active"), R.allocations(r, ALL, ["a", "b"]), {"a": ["*"], "b": ["hot", "calm"]})


@query("r09_allocations", "SELECT date, profile, sleeve, weight FROM prof JOIN pwc USING (profile)", "weight", RV)
def r09(spark, sf):
    return R.allocations(resolved(spark, sf), ALL, ["a", "b"])


@query("r09_change_points", "SELECT date, profile, prev AS from_profile FROM (SELECT date, profile, lag(profile) OVER (ORDER BY date) AS prev FROM prof) WHERE prev IS NULL OR prev <> profile", views=RV)
def r09b(spark, sf):
    return R.change_points(resolved(spark, sf))


@query("r10_smooth_weights",
       """SELECT f.date, w.sleeve, f.profile, coalesce(o.weight, w.weight) + (w.weight - coalesce(o.weight, w.weight)) * CASE WHEN f.id = 0 THEN 1 ELSE least(1.0::DOUBLE, f.elapsed / CASE WHEN e.q < eo.q THEN 3.0::DOUBLE ELSE 5.0 END) END AS weight
  FROM flips f JOIN pw w USING (profile) LEFT JOIN pw o ON o.profile = f.from_profile AND o.sleeve = w.sleeve JOIN (SELECT profile, sum(weight) AS q FROM pw GROUP BY 1) e ON e.profile = f.profile
  LEFT JOIN (SELECT profile, sum(weight) AS q FROM pw GROUP BY 1) eo ON eo.profile = f.from_profile""", "weight", RV)
def r10(spark, sf):
    r = resolved(spark, sf)
    return R.smooth_weights(R.allocations(r, ALL, ["a", "b"]), r, 3, 5)


@query("r11_smoothing_summary",
       """SELECT count(*) AS n_total, count(*) FILTER (WHERE e.q < o.q) AS n_defensive, count(*) FILTER (WHERE e.q > o.q) AS n_offensive, count(*) FILTER (WHERE e.q = o.q) AS n_lateral FROM
  (SELECT date, profile, lag(profile) OVER (ORDER BY date) AS prev FROM prof) c JOIN (SELECT profile, sum(weight) AS q FROM pw GROUP BY 1) e USING (profile)
  LEFT JOIN (SELECT profile, sum(weight) AS q FROM pw GROUP BY 1) o ON o.profile = c.prev WHERE c.prev IS NULL OR c.prev <> c.profile""", views=RV)
def r11(spark, sf):
    r = resolved(spark, sf)
    return R.smoothing_summary(r, R.allocations(r, ALL, ["a", "b"]))
