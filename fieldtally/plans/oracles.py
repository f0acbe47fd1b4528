"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

import math
import re

from fieldtally.adapters import RECORD_COLUMNS, SITE_COLUMNS, SITE_MEASURES, VISIT_COLUMNS, VISIT_MEASURES
from fieldtally.operators import dims
from fieldtally.operators.turnover import SITES_PER_BIN
from fieldtally.plans.queries import (
    CFG, EVENT_EFFECTS, EVENT_PARAMS, N_BOOT, NUMERIC_COVARIATES, SEASON_MEASURES, SPREAD_FACTORS, TBI_PREDICTORS,
)


def R(expr: str, name: str, digits: int = 6) -> str:
    return f"CAST(round({expr}, {digits}) AS DOUBLE) + 0.0 AS {name}"


def t_p(t: str, df: str, n: int = 1200) -> str:
    """Two-sided t probability by Simpson's rule on the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = (
        f"list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * pow(cos({angle} * i / {n}), {df} - 1)))"
        f" * {angle} / {3 * n}"
    )
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * ({area}))"


def f_p(f: str, n: str, d: str, steps: int = 2000) -> str:
    """Upper F probability by Simpson's rule on the angle whose squared sine is d / (d + n f)."""
    angle = f"asin(sqrt({d} / ({d} + {n} * {f})))"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(sin({angle} * i / {steps}), {d} - 1) * pow(cos({angle} * i / {steps}), {n} - 1)))"
        f" * {angle} / {3 * steps}"
    )
    return f"2 * exp(lgamma(({n} + {d}) / 2.0) - lgamma({n} / 2.0) - lgamma({d} / 2.0)) * ({area})"


def _quantile(value: str, p: float) -> str:
    return f"quantile_cont({value}, {p})"


def _cols(names, alias: str = "") -> str:
    return ", ".join(f'{alias}"{n}"' for n in names)


def poisson(uniform: str) -> str:
    total, cases = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        cases.append(f"WHEN {uniform} < {total!r} THEN {k}")
    return f"(CASE {' '.join(cases)} ELSE 12 END)"


def hash32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def hash60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


_CLEAN_PASS = [
    "category", "agro_eco_zone", "cfr_name", "village", "commune", "district", "province", "shape",
    *[m for m in SITE_MEASURES],
    *[m for m in VISIT_MEASURES if m != "water_tem"],
]

CTES: dict[str, str] = {}

CTES["visit_orders"] = """SELECT o_orderkey, o_custkey, o_totalprice, c_nationkey AS nation,
  (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS occasion
  FROM orders JOIN customer ON o_custkey = c_custkey"""
CTES["visit_sums"] = """SELECT nation, occasion, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
  min(o_totalprice) AS low_price, max(o_totalprice) AS high_price FROM visit_orders GROUP BY nation, occasion"""
CTES["visits"] = "SELECT nation, occasion, " + ", ".join(f"{e} AS {c}" for c, e in VISIT_MEASURES.items()) + " FROM visit_sums"
CTES["site_sums"] = """SELECT c.*, s.* EXCLUDE (s_nation) FROM
  (SELECT c_nationkey AS nation, count(*) AS site_customers, min(c_acctbal) AS low_balance, max(c_acctbal) AS high_balance
   FROM customer GROUP BY 1) c
  LEFT JOIN (SELECT s_nationkey AS s_nation, count(*) AS site_suppliers, min(s_acctbal) AS supplier_low,
   max(s_acctbal) AS supplier_high FROM supplier GROUP BY 1) s ON c.nation = s.s_nation"""
CTES["sites"] = "SELECT nation, " + ", ".join(f"{e} AS {c}" for c, e in SITE_MEASURES.items()) + " FROM site_sums"
CTES["part_attributes"] = """SELECT p_name AS attribute_name, arg_min(p_brand, p_partkey) AS species_family,
  'Genus ' || (arg_min(p_size, p_partkey) % 9) AS species_genus, 'Group ' || (arg_min(p_size, p_partkey) % 5) AS species_group,
  arg_min(p_type, p_partkey) AS species_type FROM part GROUP BY p_name"""
CTES["raw"] = (
    "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in {**RECORD_COLUMNS, **VISIT_COLUMNS, **SITE_COLUMNS}.items())
    + ", date_diff('day', DATE '1899-12-30', CAST(DATE '1994-11-01' + to_months(CAST(3 * (o.occasion - 1) AS INTEGER)) AS DATE)) AS date, "
    + _cols(VISIT_MEASURES, "v.") + ", " + _cols(SITE_MEASURES, "t.")
    + """ FROM lineitem JOIN visit_orders o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN nation ON o.nation = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part_attributes ON p_name = attribute_name
  LEFT JOIN visits v ON v.nation = o.nation AND v.occasion = o.occasion
  LEFT JOIN sites t ON t.nation = o.nation"""
).replace("nation + 1 AS", "o.nation + 1 AS").replace("(nation ", "(o.nation ").replace(" nation %", " o.nation %").replace("1 + nation", "1 + o.nation").replace("(nation AS", "(o.nation AS").replace("CASE nation", "CASE o.nation").replace("+ occasion)", "+ o.occasion)").replace("* occasion)", "* o.occasion)").replace("WHEN occasion %", "WHEN o.occasion %").replace('occasion AS "occasion"', 'o.occasion AS "occasion"').replace("(3 * (o.occasion - 1)", "(3 * (o.occasion - 1)").replace("(o.nation * 3)", "(o.nation * 3)")
CTES["labelled"] = (
    """SELECT cfr_id, occasion AS occ_no, replicate_no, gear AS gear_name, gear_code AS gear, speciescode,
  upper(substr(species_name, 1, 1)) || lower(substr(species_name, 2)) AS species_name, family, genus, "group", type,
  DATE '1899-12-30' + CAST(date AS INTEGER) AS date, fi_a_designated AS fia_designated, category_name,
  (large_wb_yes_1_no_2 = 1) AS large_water_body,
  CASE channel_1_earth_2_concrete_3_both WHEN 0 THEN 'None' WHEN 1 THEN 'Earth' WHEN 3 THEN 'Earth & Concrete' END AS channel_type,
  coalesce(type_inlet_outlet, 'None') AS type_inlet_outlet,
  lower(illegal_fishing_seen) <> 'no' AS illegal_fishing, lower(water_bird) <> 'no' AS water_bird,
  lower(other_animal) <> 'no' AS other_animal, lower(weather) AS weather, water_tem AS water_temp,
  net_l AS net_length, net_area, depth_shore, depth_end, time_in, duration, no_fish, total_weight,
  min_length, max_length, min_weight, max_weight, mean_weight, category_1 AS category, """
    + _cols([c for c in _CLEAN_PASS if c != "category"])
    + " FROM raw WHERE NOT regexp_matches(upper(substr(species_name, 1, 1)) || lower(substr(species_name, 2)), 'Unname')"
)
CTES["coded"] = """SELECT *, min(speciescode) OVER (PARTITION BY species_name) AS species_code FROM labelled"""
CTES["padded"] = """SELECT *,
  'fr' || lpad(cfr_id::VARCHAR, CAST(length((SELECT max(cfr_id) FROM coded)::VARCHAR) AS INTEGER), '0') AS refuge,
  'oc' || lpad(occ_no::VARCHAR, CAST(length((SELECT max(occ_no) FROM coded)::VARCHAR) AS INTEGER), '0') AS occasion,
  're' || lpad(replicate_no::VARCHAR, CAST(length((SELECT max(replicate_no) FROM coded)::VARCHAR) AS INTEGER), '0') AS replicate,
  'sp' || lpad(species_code::VARCHAR, CAST(length((SELECT max(species_code) FROM coded)::VARCHAR) AS INTEGER), '0') AS species FROM coded"""
CTES["clean"] = """SELECT * EXCLUDE (cfr_id, occ_no, replicate_no, speciescode), refuge || '_' || occasion AS refuge_occasion,
  refuge || '_' || occasion || '_' || replicate || '_' || gear AS sampling FROM padded"""
CTES["refuge_info"] = (
    "SELECT DISTINCT " + _cols([c for c in dims.REFUGE_COLUMNS if c != "category_name"])
    + r", regexp_replace(category_name, '\s\(.+\)', '') AS category_name FROM clean"
)
CTES["occasion_info"] = (
    "SELECT DISTINCT " + _cols([c for c in dims.OCCASION_COLUMNS if c != "aquatic_plant_density"])
    + ", CASE WHEN aquatic_plant_density > 100 THEN 100 ELSE aquatic_plant_density END AS aquatic_plant_density FROM clean"
)
CTES["sampling_info"] = "SELECT DISTINCT " + _cols(dims.SAMPLING_COLUMNS) + " FROM clean"
CTES["species_base"] = "SELECT DISTINCT " + _cols(dims.SPECIES_COLUMNS) + " FROM clean"
CTES["type_ranks"] = "SELECT type, rank() OVER (ORDER BY count(*) DESC) AS r FROM species_base GROUP BY type"
CTES["species_info"] = """SELECT s.*, CASE WHEN r <= 3 THEN s.type ELSE 'Other' END AS species_type_simple
  FROM species_base s LEFT JOIN type_ranks USING (type)"""
CTES["occasion_dated"] = """SELECT *, CAST(year(date) AS VARCHAR) AS year, CAST(month(date) AS VARCHAR) AS month,
  CASE WHEN month(date) IN (2, 5) THEN 'dry' ELSE 'wet' END AS season,
  CAST(floor((CAST(substr(occasion, 3) AS INTEGER) - 1) / 4) AS INTEGER) AS year_s FROM occasion_info"""
CTES["occasion_covariates"] = """SELECT DISTINCT refuge, occasion, year, season, month,
  (gauge_start + gauge_finish) / 2 AS water_level, water_temp, secchi_depth AS visibility, aquatic_plant_area,
  aquatic_plant_area * aquatic_plant_density AS aquatic_plant_index, brush_park, year_s, 'm_' || month AS month_s FROM occasion_dated"""
CTES["refuge_covariates"] = """SELECT refuge, CAST(category AS VARCHAR) AS category, cfr_name, category_name,
  area_dry_ha AS dry_area, depth_dry_m AS dry_depth, large_water_body FROM refuge_info"""
_side = ", ".join(
    f"{{m}}.{c} AS {c}_m{{n}}" for c in dims.TURNOVER_OCCASION_MEASURES
)
CTES["dry_visits"] = "SELECT DISTINCT refuge, year_s, " + _cols(dims.TURNOVER_OCCASION_MEASURES) + " FROM occasion_dated WHERE season = 'dry'"
CTES["cov_occasion_beta"] = (
    "SELECT coalesce(a.refuge, b.refuge) AS refuge, coalesce(a.year_s, b.year_s) AS year_s, "
    + _side.format(m="a", n="2") + ", " + _side.format(m="b", n="5")
    + ", b.water_temp - a.water_temp AS water_temp_diff, b.gauge_start - a.gauge_start AS gauge_start_diff "
    "FROM (SELECT * FROM dry_visits WHERE month = '2') a FULL JOIN (SELECT * FROM dry_visits WHERE month = '5') b "
    "ON a.refuge = b.refuge AND a.year_s = b.year_s"
)
CTES["cov_refuge_beta"] = (
    "SELECT "
    + ", ".join(
        f"ln(1 + {c}) AS {c}" if c in dims.LOGGED_REFUGE_COLUMNS else c for c in dims.TURNOVER_REFUGE_COLUMNS
    )
    + " FROM refuge_info"
)
CTES["gn"] = "SELECT * FROM clean WHERE gear = 'GN'"
CTES["max_reps"] = """SELECT refuge, max(n) AS n_samples FROM
  (SELECT refuge, occasion, count(DISTINCT replicate) AS n FROM gn GROUP BY ALL) GROUP BY refuge"""
CTES["raw_totals"] = """SELECT refuge, occasion, gear, species, CAST(sum(no_fish) AS DOUBLE) AS no_fish,
  CAST(sum(total_weight) AS DOUBLE) AS total_weight, any_value(n_samples) AS n_samples
  FROM gn JOIN max_reps USING (refuge) GROUP BY refuge, occasion, gear, species"""
CTES["std_totals"] = """SELECT refuge, occasion, gear, species, CAST(round_even(no_fish / n_samples * 8, 0) AS DOUBLE) AS no_fish,
  CAST(round_even(total_weight / n_samples * 8, 0) AS DOUBLE) AS total_weight, n_samples FROM raw_totals"""
CTES["mean_totals"] = """SELECT refuge, occasion, gear, species, CAST(round_even(avg(no_fish) * 8, 0) AS DOUBLE) AS no_fish,
  CAST(round_even(avg(total_weight) * 8, 0) AS DOUBLE) AS total_weight FROM clean GROUP BY ALL"""
CTES["catch_full"] = """SELECT year_s, season, month, refuge, species, sum(no_fish) AS count FROM std_totals
  LEFT JOIN (SELECT DISTINCT refuge, occasion, year_s, season, month FROM occasion_covariates) USING (refuge, occasion)
  WHERE year_s < 6 AND NOT (refuge = 'fr15' AND year_s = 0) GROUP BY ALL"""


def alpha(source: str, value: str, keys: str = "refuge, occasion, gear") -> str:
    return f"""SELECT *, v / nullif(sum(v) OVER (PARTITION BY {keys}), 0) AS p FROM (SELECT *, {value} AS v FROM {source})"""


def shannon(base: str = "exp(1)") -> str:
    return f"abs(coalesce(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 0) / ln({base}))"


CTES["alpha_cells"] = alpha("raw_totals", "ln(1 + no_fish)")
CTES["alpha_raw"] = f"""SELECT refuge, occasion, gear, {shannon()} AS diversity_alpha, 'shannon' AS index,
  exp(1) AS base, 'log1p' AS transform_fun, max(n_samples) AS n_samples FROM alpha_cells GROUP BY refuge, occasion, gear"""
CTES["alpha_all_cells"] = alpha("mean_totals", "ln(1 + no_fish)")
CTES["alpha_all"] = f"SELECT refuge, occasion, gear, {shannon()} AS diversity_alpha FROM alpha_all_cells GROUP BY ALL"
CTES["frame"] = """SELECT * FROM alpha_raw LEFT JOIN occasion_covariates USING (refuge, occasion)
  LEFT JOIN refuge_covariates USING (refuge)"""
CTES["by_month"] = """SELECT refuge, year, n_samples,
  max(CASE WHEN month_s = 'm_2' THEN diversity_alpha END) AS m_2, max(CASE WHEN month_s = 'm_5' THEN diversity_alpha END) AS m_5,
  max(CASE WHEN month_s = 'm_8' THEN diversity_alpha END) AS m_8, max(CASE WHEN month_s = 'm_11' THEN diversity_alpha END) AS m_11
  FROM frame GROUP BY refuge, year, n_samples"""
CTES["month_frame"] = "SELECT * FROM by_month LEFT JOIN refuge_covariates USING (refuge) WHERE m_5 <> 0"

CTES["comparisons"] = "SELECT * FROM (VALUES ('2 5', '2', '5'), ('5 8', '5', '8'), ('5 11', '5', '11')) t(comparison, m1, m2)"
CTES["kinds"] = "SELECT * FROM (VALUES (true), (false)) t(pa_tr)"
CTES["visited"] = "SELECT DISTINCT refuge, year_s, month FROM catch_full"
CTES["pairs"] = """SELECT comparison, a.refuge, a.year_s FROM comparisons JOIN visited a ON a.month = m1
  JOIN visited b ON b.month = m2 AND a.refuge = b.refuge AND a.year_s = b.year_s"""
CTES["pair_cells"] = """SELECT comparison, refuge, year_s, species, pa_tr,
  CASE WHEN pa_tr THEN CAST(y1 > 0 AS INTEGER) ELSE ln(1 + y1) END AS y1,
  CASE WHEN pa_tr THEN CAST(y2 > 0 AS INTEGER) ELSE ln(1 + y2) END AS y2 FROM
  (SELECT comparison, refuge, year_s, species, coalesce(sum(count) FILTER (month = m1), 0) AS y1,
    coalesce(sum(count) FILTER (month = m2), 0) AS y2
   FROM pairs JOIN comparisons USING (comparison) JOIN catch_full USING (refuge, year_s) GROUP BY ALL), kinds"""
CTES["parts"] = """SELECT comparison, pa_tr, refuge, year_s, sum(least(y1, y2)) AS a, sum(greatest(y1 - y2, 0)) AS b,
  sum(greatest(y2 - y1, 0)) AS c FROM pair_cells GROUP BY ALL"""
CTES["tbi"] = """SELECT comparison, pa_tr, year_s, refuge, b / nullif(2 * a + b + c, 0) AS b_stnd, c / nullif(2 * a + b + c, 0) AS c_stnd,
  (b + c) / nullif(2 * a + b + c, 0) AS d, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM parts"""
_scaled = [
    "no_inlet_outlet", "lwb_depth_dry_m", "lwb_area_wet_ha", "no_channel", "rf_area_connected_in_dry_season_ha",
    "rf_area_connected_in_wet_season_ha", "dist_village", "dist_market",
    *[f"{c}_m{m}" for m in (2, 5) for c in ("aquatic_plant_area", "gauge_start", "water_temp", "phosphate", "brush_park")],
    "water_temp_diff", "gauge_start_diff",
]
_flags = ["pa_tr", "large_water_body", *[f"{c}_m{m}" for m in (2, 5) for c in ("illegal_fishing", "other_animal", "water_bird")]]
_plain_tbi = [
    "comparison", "year_s", "refuge", "b_stnd", "c_stnd", "d", "b", "c", "cfr_name", "category_name", "channel_type", "shape",
    "type_inlet_outlet", *[f"{c}_m{m}" for m in (2, 5) for c in ("occasion", "month", "season")],
]
CTES["tbi_joined"] = """SELECT * FROM (SELECT * FROM tbi WHERE comparison = '2 5') LEFT JOIN cov_refuge_beta USING (refuge)
  LEFT JOIN cov_occasion_beta USING (refuge, year_s)"""
CTES["tbi_frame"] = (
    "SELECT " + ", ".join(_plain_tbi) + ", "
    + ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}" for c in _scaled) + ", "
    + ", ".join(f"CASE WHEN {c} THEN 'yes' WHEN NOT {c} THEN 'no' END AS {c}" for c in _flags)
    + " FROM tbi_joined"
)

CTES["perms"] = f"SELECT range AS perm FROM range({CFG.n_perm})"


def sign(units: str) -> str:
    return f"1 - 2 * ((bits >> CAST(perm % 60 AS INTEGER)) & 1)"


CTES["unit_bits"] = f"""SELECT refuge, year_s, block, {hash60("'0'", "refuge", "year_s::VARCHAR", "block::VARCHAR")} AS bits
  FROM (SELECT DISTINCT refuge, year_s FROM pairs), (SELECT range AS block FROM range({math.ceil(CFG.n_perm / 60)}))"""
CTES["unit_signs"] = f"""SELECT refuge, year_s, perm, {sign('')} AS s FROM unit_bits JOIN perms ON block = perm // 60"""
CTES["diffs"] = """SELECT refuge, year_s, species, y2 - y1 AS diff FROM pair_cells WHERE comparison = '2 5' AND NOT pa_tr"""
CTES["n_pairs"] = "SELECT count(*) AS n FROM pairs WHERE comparison = '2 5'"
CTES["diff_stats"] = """SELECT species, n AS n_pairs, sum(diff) AS total,
  CASE WHEN abs(sum(diff)) < 1e-9 THEN 0 ELSE sum(diff) / n END AS mean_diff,
  CASE WHEN abs(sum(diff)) < 1e-9 THEN 0 ELSE (sum(diff) / n) / nullif(sqrt((sum(diff * diff) - n * pow(sum(diff) / n, 2)) / (n - 1) / n), 0) END AS t
  FROM diffs, n_pairs GROUP BY species, n HAVING sum(diff * diff) > 0"""
CTES["perm_sums"] = """SELECT species, perm, sum(s * diff) AS ps FROM diffs JOIN unit_signs USING (refuge, year_s) WHERE diff <> 0 GROUP BY species, perm"""
CTES["perm_hits"] = """SELECT species, count(*) FILTER (abs(ps) >= abs(total) - 1e-9) AS hits FROM perm_sums JOIN diff_stats USING (species) GROUP BY species"""
CTES["tests"] = f"""SELECT species, n_pairs, mean_diff, t,
  CASE WHEN t <> 0 THEN {t_p('t', '(n_pairs - 1)')} END AS p_value_param,
  CASE WHEN t <> 0 THEN (hits + 1) / {CFG.n_perm + 1}.0 END AS p_value_perm FROM diff_stats JOIN perm_hits USING (species)"""


def holm(p: str, order: str) -> str:
    """Step-down adjustment over the non-NULL values."""
    rank = f"row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}, {order})"
    m = f"count({p}) OVER ()"
    return f"CASE WHEN {p} IS NOT NULL THEN ({m} - {rank} + 1) * {p} END"


CTES["changes_step"] = f"SELECT *, {holm('p_value_param', 'species')} AS step FROM tests LEFT JOIN species_info USING (species)"
CTES["changes"] = """SELECT * EXCLUDE (step), CASE WHEN step IS NOT NULL THEN
  least(1, max(step) OVER (PARTITION BY step IS NULL ORDER BY p_value_param, species ROWS UNBOUNDED PRECEDING)) END AS p_value_param_adjust
  FROM changes_step"""
CTES["dry"] = "SELECT * FROM catch_full WHERE season = 'dry'"
CTES["dry_n"] = "SELECT count(*) AS n FROM (SELECT DISTINCT year_s, season, month, refuge FROM dry)"
CTES["occurrence"] = """SELECT *, row_number() OVER (ORDER BY mean_count DESC, species) <= 10 AS top FROM
  (SELECT species, sum(count) / n AS mean_count, avg(count) FILTER (count > 0) AS mean_count_pres,
    count(*) FILTER (count > 0) / n AS perc_samplings FROM dry, dry_n GROUP BY species, n)"""
CTES["report_step"] = f"""SELECT *, {holm('p_value_perm', 'species')} AS step FROM changes FULL JOIN occurrence USING (species)"""
CTES["report"] = """SELECT *, CASE WHEN step IS NOT NULL THEN
  least(1, max(step) OVER (PARTITION BY step IS NULL ORDER BY p_value_perm, species ROWS UNBOUNDED PRECEDING)) END AS p_value_perm_adjust
  FROM report_step"""
CTES["cumulative"] = """SELECT species, total_count, total_count / sum(total_count) OVER () AS perc_count,
  coalesce(sum(total_count) OVER (ORDER BY total_count DESC, species ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(total_count) OVER () AS share_before
  FROM (SELECT species, sum(count) AS total_count FROM dry GROUP BY species)"""
CTES["type_lump"] = """SELECT s.species, CASE WHEN r <= 3 THEN snake ELSE 'other' END AS type_group FROM
  (SELECT DISTINCT species, lower(regexp_replace(trim(type), '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM species_info) s
  JOIN (SELECT snake, rank() OVER (ORDER BY count(*) DESC) AS r FROM
   (SELECT DISTINCT species, lower(regexp_replace(trim(type), '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM species_info) GROUP BY snake) USING (snake)"""
CTES["type_comp"] = """SELECT refuge, occasion, type_group, sum(ln(1 + no_fish)) AS n FROM mean_totals LEFT JOIN type_lump USING (species)
  WHERE gear = 'GN' GROUP BY ALL"""
CTES["composition"] = """SELECT occasion, gear, species, gn.species_name, species_type_simple, sum(no_fish) AS no_fish,
  CAST(sum(total_weight) AS DOUBLE) AS total_weight, sum(min_length) AS min_length, sum(max_length) AS max_length,
  sum(min_weight) AS min_weight, sum(max_weight) AS max_weight, sum(mean_weight) AS mean_weight
  FROM gn JOIN species_info USING (species) GROUP BY ALL"""
CTES["ca_cells"] = "SELECT refuge, occasion, species, ln(1 + no_fish) AS x FROM mean_totals WHERE gear = 'GN' AND no_fish > 0"
CTES["drawn"] = "SELECT row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS draw, event_type AS param, value FROM events"
CTES["draw_wide"] = """SELECT draw, max(CASE WHEN param = 'click' THEN value END) AS click, max(CASE WHEN param = 'error' THEN value END) AS error,
  max(CASE WHEN param = 'purchase' THEN value END) AS purchase, max(CASE WHEN param = 'signup' THEN value END) AS signup,
  max(CASE WHEN param = 'view' THEN value END) AS view FROM drawn GROUP BY draw"""


def named(mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"SELECT draw, CASE param {cases} END AS param, value - 40 AS value FROM drawn"


CTES["named_params"] = named(EVENT_PARAMS)
CTES["named_effects"] = named(EVENT_EFFECTS)

_NAMES = re.compile(r"\b[a-z_0-9]+\b")


def with_ctes(sql: str) -> str:
    """Prefix the common table expressions a statement needs, in definition order."""
    needed, stack = set(), [sql]
    while stack:
        for word in _NAMES.findall(stack.pop()):
            if word in CTES and word not in needed:
                needed.add(word)
                stack.append(CTES[word])
    if not needed:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + " " + sql


ORACLES: dict[str, str] = {}


def every(source: str, doubles, others, digits: int = 6) -> str:
    """Select with the doubles rounded."""
    picked = [R(f'"{c}"', f'"{c}"', digits) for c in doubles] + [f'"{c}"' for c in others]
    return f"SELECT {', '.join(picked)} FROM {source}"


_SIZES = ["no_fish", "min_length", "max_length", "min_weight", "max_weight", "mean_weight"]
_SITE = list(SITE_MEASURES)
_VISIT = [m if m != "water_tem" else "water_temp" for m in VISIT_MEASURES]
_NET = ["net_length", "net_area", "depth_shore", "depth_end"]
_doubles_all = [*_SIZES, *_SITE, *_VISIT, *_NET]
_others_all = [
    "sampling", "refuge", "occasion", "replicate", "gear_name", "gear", "species_code", "species_name", "family", "genus", "group",
    "type", "category", "category_name", "fia_designated", "large_water_body", "channel_type", "type_inlet_outlet", "illegal_fishing",
    "water_bird", "other_animal", "weather", "time_in", "duration", "cfr_name", "village", "commune", "district", "province",
    "agro_eco_zone", "shape", "date", "species", "refuge_occasion",
]
ORACLES["clean_survey"] = every("clean", _doubles_all, _others_all).replace(" FROM clean", ", CAST(total_weight AS DOUBLE) AS total_weight FROM clean")
ORACLES["dim_refuge"] = every("refuge_info", _SITE, [c for c in dims.REFUGE_COLUMNS if c not in _SITE])
ORACLES["dim_occasion"] = every("occasion_info", _VISIT, [c for c in dims.OCCASION_COLUMNS if c not in _VISIT])
ORACLES["dim_sampling"] = every("sampling_info", _NET, [c for c in dims.SAMPLING_COLUMNS if c not in _NET])
ORACLES["dim_species"] = every("species_info", [], [*dims.SPECIES_COLUMNS, "species_type_simple"])
ORACLES["dim_casting"] = "SELECT DISTINCT " + _cols(dims.CASTING_COLUMNS) + " FROM clean"
ORACLES["fact_catch"] = (
    "SELECT " + ", ".join(R(c, c) for c in _SIZES)
    + ", CAST(total_weight AS DOUBLE) AS total_weight, refuge, occasion, replicate, gear, sampling, species FROM clean"
)
_cov_num = ["water_level", "water_temp", "visibility", "aquatic_plant_area", "aquatic_plant_index", "brush_park"]
ORACLES["cov_occasion"] = every("occasion_covariates", _cov_num, ["refuge", "occasion", "year", "season", "month", "year_s", "month_s"])
ORACLES["cov_refuge"] = every("refuge_covariates", ["dry_area", "dry_depth"], ["refuge", "category", "cfr_name", "category_name", "large_water_body"])
_beta_num = [f"{c}_m{m}" for m in (2, 5) for c in ("aquatic_plant_area", "gauge_start", "water_temp", "phosphate", "brush_park")] + ["water_temp_diff", "gauge_start_diff"]
_beta_oth = ["refuge", "year_s"] + [f"{c}_m{m}" for m in (2, 5) for c in ("occasion", "month", "season", "illegal_fishing", "other_animal", "water_bird")]
ORACLES["cov_occasion_beta"] = every("cov_occasion_beta", _beta_num, _beta_oth)
_rb_num = [c for c in dims.TURNOVER_REFUGE_COLUMNS if c in SITE_MEASURES]
ORACLES["cov_refuge_beta"] = every("cov_refuge_beta", _rb_num, [c for c in dims.TURNOVER_REFUGE_COLUMNS if c not in _rb_num])
ORACLES["tbi_model_frame"] = every(
    "tbi_frame", ["b_stnd", "c_stnd", "d", "b", "c", *_scaled], [c for c in _plain_tbi if c not in ("b_stnd", "c_stnd", "d", "b", "c")] + _flags
)


def duplicates(table: str, keys: list[str], source: str | None = None) -> str:
    value = " || '|' || ".join(keys)
    return (
        f"SELECT '{table}' AS table_name, '{','.join(keys)}' AS key_columns, {value} AS key_value, count(*) AS n_rows "
        f"FROM {source or table} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
    )


ORACLES["quality_duplicates"] = " UNION ALL ".join(
    [
        duplicates("refuge_info", ["refuge"]), duplicates("occasion_info", ["sampling"]), duplicates("sampling_info", ["sampling"]),
        duplicates("species_info", ["species"]), duplicates("catch_info", ["sampling", "species"], "clean"), duplicates("part", ["p_name"]),
    ]
)
ORACLES["effort_max_replicates"] = "SELECT refuge, n_samples FROM max_reps"
ORACLES["effort_standardised"] = "SELECT refuge, occasion, gear, species, no_fish, total_weight, n_samples FROM std_totals"
ORACLES["effort_totals_tagged"] = """SELECT refuge, occasion, gear, species, no_fish, round(total_weight, 6) AS total_weight, n_samples, 'standard_totals' AS standard FROM std_totals
  UNION ALL SELECT refuge, occasion, gear, species, no_fish, round(total_weight, 6), n_samples, 'raw_totals' FROM raw_totals"""
ORACLES["effort_mean_scaled"] = "SELECT refuge, occasion, gear, species, no_fish, total_weight FROM mean_totals"
ORACLES["catch_full"] = "SELECT year_s, season, month, refuge, species, count FROM catch_full"
ORACLES["catch_wide"] = "SELECT year_s, refuge, species, " + ", ".join(
    f"coalesce(sum(count) FILTER (month = '{m}'), 0) + 0.0 AS m_{m}" for m in (2, 5, 8, 11)
) + " FROM catch_full GROUP BY ALL"
ORACLES["change_table"] = "SELECT month, year_s, refuge, species, " + R("ln(1 + count)", "log_count") + " FROM catch_full"
_alpha_out = ", ".join(["refuge, occasion, gear", R("diversity_alpha", "diversity_alpha"), "index", R("base", "base"), "transform_fun", "n_samples"])
ORACLES["alpha_shannon"] = f"SELECT {_alpha_out} FROM alpha_raw"


def _alpha_query(source: str, value: str, measure: str, index: str, base: str, transform: str, effort: bool = True) -> str:
    tail = ", max(n_samples) AS n_samples" if effort else ""
    return (
        f"SELECT refuge, occasion, gear, {R(measure, 'diversity_alpha')}, '{index}' AS index, {R(base, 'base')}, "
        f"'{transform}' AS transform_fun{tail} FROM ({alpha(source, value)}) GROUP BY refuge, occasion, gear"
    )


ORACLES["alpha_shannon_base2"] = _alpha_query("std_totals", "total_weight", shannon("2"), "shannon", "2.0", "I")
ORACLES["alpha_simpson"] = _alpha_query("std_totals", "no_fish", "1 - coalesce(sum(p * p), 0)", "simpson", "exp(1)", "I")
ORACLES["alpha_inverse_simpson"] = _alpha_query("std_totals", "no_fish", "1 / sum(p * p)", "invsimpson", "exp(1)", "I")
ORACLES["alpha_all_gears"] = _alpha_query("mean_totals", "ln(1 + no_fish)", shannon(), "shannon", "exp(1)", "log1p", effort=False)
_frame_num = ["diversity_alpha", "base", *_cov_num, "dry_area", "dry_depth"]
_frame_oth = [
    "refuge", "occasion", "gear", "index", "transform_fun", "n_samples", "year", "season", "month", "year_s", "month_s", "category",
    "cfr_name", "category_name", "large_water_body",
]
ORACLES["alpha_frame"] = every("frame", _frame_num, _frame_oth)
ORACLES["alpha_by_month_wide"] = every(
    "month_frame", ["m_2", "m_5", "m_8", "m_11", "dry_area", "dry_depth"],
    ["refuge", "year", "n_samples", "category", "cfr_name", "category_name", "large_water_body"],
)
_tbi_out = every("tbi", ["b_stnd", "c_stnd", "d", "b", "c"], ["comparison", "pa_tr", "year_s", "refuge"])
ORACLES["tbi_abundance"] = _tbi_out + " WHERE NOT pa_tr"
ORACLES["tbi_presence"] = _tbi_out + " WHERE pa_tr"
ORACLES["tbi_unpaired"] = """SELECT year_s, refuge, comparison, CASE WHEN has1 THEN m2 ELSE m1 END AS missing_month FROM
  (SELECT year_s, refuge, comparison, m1, m2, bool_or(month = m1) AS has1, bool_or(month = m2) AS has2
   FROM visited, comparisons GROUP BY ALL) WHERE has1 <> has2"""
ORACLES["tbi_net_change"] = f"""SELECT comparison, pa_tr, count(d) AS n_pairs, {R('avg(c_stnd - b_stnd)', 'net_change')},
  {R('stddev_samp(c_stnd - b_stnd) / sqrt(count(d))', 'net_change_se')}, {R('avg(b_stnd / nullif(d, 0))', 'loss_share')} FROM tbi GROUP BY comparison, pa_tr"""
ORACLES["tbi_gain_loss_test"] = f"""SELECT comparison, pa_tr, n_pairs, {R('mean_diff', 'mean_diff')}, {R('t', 't')},
  {R(t_p('t', '(n_pairs - 1)'), 'p_value_param')}, {R(f'(hits + 1) / {CFG.n_perm + 1}.0', 'p_value_perm')} FROM
  (SELECT comparison, pa_tr, count(*) AS n_pairs, avg(ch) AS mean_diff, sum(ch) AS total,
    avg(ch) / nullif(stddev_samp(ch) / sqrt(count(*)), 0) AS t FROM (SELECT *, c_stnd - b_stnd AS ch FROM tbi WHERE d IS NOT NULL) GROUP BY ALL)
  JOIN (SELECT comparison, pa_tr, count(*) FILTER (abs(ps) >= abs(tot) - 1e-9) AS hits FROM
    (SELECT comparison, pa_tr, perm, sum(s * (c_stnd - b_stnd)) AS ps, sum(c_stnd - b_stnd) AS tot FROM tbi JOIN unit_signs USING (refuge, year_s) WHERE d IS NOT NULL GROUP BY ALL)
    GROUP BY ALL) USING (comparison, pa_tr)"""
ORACLES["tbi_perm_p"] = f"""SELECT * FROM (WITH site_bins AS (SELECT *, n // bins + CASE WHEN bin < n % bins THEN 1 ELSE 0 END AS in_bin,
    ({CFG.n_perm} + n // bins - 1) // (n // bins) AS rotations FROM
    (SELECT *, site % bins AS bin FROM (SELECT *, greatest(1, n // {SITES_PER_BIN}) AS bins FROM
      (SELECT comparison, refuge, year_s, row_number() OVER (PARTITION BY comparison ORDER BY year_s, refuge) - 1 AS site,
       count(*) OVER (PARTITION BY comparison) AS n FROM pairs)))),
  draws AS (SELECT comparison, pa_tr, rotation, target, target % bins AS bin, (sum(greatest(y1 - y2, 0)) + sum(greatest(y2 - y1, 0)))
     / nullif(2 * sum(least(y1, y2)) + sum(abs(y1 - y2)), 0) AS ds FROM
    (SELECT comparison, pa_tr, bins, rotation, y1, y2, (site + {hash32("'0'", "species", "rotation::VARCHAR")}) % n AS target
     FROM (SELECT *, unnest(range(1, rotations + 1)) AS rotation FROM pair_cells JOIN site_bins USING (comparison, refuge, year_s) WHERE y1 + y2 > 0))
    GROUP BY comparison, pa_tr, rotation, target, bins),
  counted AS (SELECT o.comparison, o.pa_tr, o.year_s, o.refuge, any_value(d) AS d, any_value(rotations * in_bin) AS n_draws,
    count(*) FILTER (ds >= d - 1e-9) AS hits
    FROM tbi o JOIN site_bins USING (comparison, year_s, refuge) LEFT JOIN draws USING (comparison, pa_tr, bin)
    GROUP BY o.comparison, o.pa_tr, o.year_s, o.refuge)
  SELECT comparison, pa_tr, year_s, refuge, {R('d', 'd')},
  {R('CASE WHEN d IS NOT NULL THEN (hits + 1) / (n_draws + 1.0) END', 'p_value')} FROM counted)"""
ORACLES["species_change"] = every(
    "changes", ["mean_diff", "t", "p_value_param", "p_value_perm", "p_value_param_adjust"],
    ["species", "n_pairs", "species_name", "species_code", "family", "genus", "group", "type", "species_type_simple"],
)


def p_text(p: str) -> str:
    return f"CASE WHEN printf('%.3f', round_even({p}, 3)) = '0.000' THEN '<0.001' ELSE printf('%.3f', round_even({p}, 3)) END"


ORACLES["species_table"] = f"""SELECT species, species_name, species_type_simple,
  printf('%.1f', round((exp(mean_diff) - 1) * 100, 1) + 0.0) || '%' AS perc_change,
  CASE WHEN p_value_perm IS NOT NULL THEN {p_text('p_value_perm')} END AS p_value_perm,
  CASE WHEN p_value_perm_adjust IS NOT NULL THEN {p_text('p_value_perm_adjust')} END AS p_value_perm_adjust,
  printf('%.1f', round(mean_count, 1)) AS mean_count, printf('%.1f', round(perc_samplings * 100, 1)) || '%' AS  perc_samplings, top,
  row_number() OVER (ORDER BY report.p_value_perm NULLS LAST, report.p_value_perm_adjust NULLS LAST, species) AS place
  FROM report WHERE p_value_perm <= 0.05 OR top"""
ORACLES["species_occurrence"] = every("occurrence", ["mean_count", "mean_count_pres", "perc_samplings"], ["species", "top"])
ORACLES["species_cumulative_share"] = every("cumulative", ["total_count", "perc_count", "share_before"], ["species"])
ORACLES["top_species"] = """SELECT CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ', and ' || l[-1] END AS species_list, len(l) AS n_species FROM
  (SELECT list(species_name ORDER BY total_count DESC, species) AS l FROM cumulative LEFT JOIN (SELECT species, species_name FROM species_info) USING (species) WHERE share_before < 0.5)"""
ORACLES["gear_bias"] = f"""SELECT species, gear, n, {R('CASE WHEN n > 0 THEN ln(n) END', 'log_n')}, species_rank,
  CAST(least(7, greatest(1, ceil((species_rank - 1) / ((max(species_rank) OVER () - 1) / 7.0)))) AS INTEGER) AS species_bin FROM
  (SELECT s.species, g.gear, coalesce(n, 0) AS n, species_rank FROM
   (SELECT species, row_number() OVER (ORDER BY count(*) DESC, species) AS species_rank FROM clean GROUP BY species) s
   CROSS JOIN (SELECT DISTINCT gear FROM clean) g LEFT JOIN (SELECT species, gear, count(*) AS n FROM clean GROUP BY ALL) c ON c.species = s.species AND c.gear = g.gear)"""
ORACLES["coverage_matrix"] = """SELECT refuge, occasion, replicate, gear, n, refuge_rank FROM
  (SELECT r.refuge, o.occasion, p.replicate, g.gear, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT refuge FROM clean) r, (SELECT DISTINCT occasion FROM clean) o,
    (SELECT DISTINCT replicate FROM clean) p CROSS JOIN (SELECT DISTINCT gear FROM clean) g
    LEFT JOIN (SELECT refuge, occasion, replicate, gear, count(*) AS n FROM clean GROUP BY ALL) c
    ON c.refuge = r.refuge AND c.occasion = o.occasion AND c.replicate = p.replicate AND c.gear = g.gear) full_grid
  JOIN (SELECT refuge, row_number() OVER (ORDER BY (SELECT count(*) FROM (SELECT DISTINCT occasion FROM clean)) * (SELECT count(DISTINCT replicate) FROM clean) * (SELECT count(DISTINCT gear) FROM clean)
     - count(DISTINCT (occasion, replicate, gear)), refuge) AS refuge_rank FROM clean GROUP BY refuge) USING (refuge)"""
ORACLES["catch_composition"] = every("composition", ["no_fish", "total_weight", "min_length", "max_length", "min_weight", "max_weight", "mean_weight"], ["occasion", "gear", "species", "species_name", "species_type_simple"])
ORACLES["composition_by_type"] = f"""SELECT occasion, species_type_simple, count(*) AS n_species, {R('sum(no_fish)', 'no_fish')}, {R('sum(total_weight)', 'total_weight')}, any_value(type_rank) AS type_rank
  FROM composition JOIN (SELECT species_type_simple, row_number() OVER (ORDER BY sum(no_fish) DESC, species_type_simple) AS type_rank FROM composition GROUP BY 1) USING (species_type_simple) GROUP BY occasion, species_type_simple"""
ORACLES["type_composition"] = every("type_comp", ["n"], ["refuge", "occasion", "type_group"])
_frame_columns = [*_frame_num, *_frame_oth]
ORACLES["profile_na"] = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count(\"{c}\") AS n_missing, {R(f'(count(*) - count({chr(34)}{c}{chr(34)})) * 100.0 / count(*)', 'pct_missing')} FROM frame" for c in _frame_columns
)


def cat_profile(columns, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(\"{c}\" AS VARCHAR) AS level, count(*) AS n, count(*) / (SELECT count(*) FROM frame WHERE {where}) AS share FROM frame WHERE {where} GROUP BY \"{c}\""
        for c in columns
    )


ORACLES["profile_cat"] = f"SELECT variable, level, n, {R('share', 'share')} FROM ({cat_profile(['season', 'month', 'year', 'category_name', 'large_water_body'])})"
_cc = ["season", "month", "year", "category_name"]
ORACLES["profile_compare"] = f"""SELECT variable, level, {R('coalesce(a.share, 0)', 'share_1')}, {R('coalesce(b.share, 0)', 'share_2')}
  FROM ({cat_profile(_cc, 'water_temp IS NULL')}) a FULL JOIN ({cat_profile(_cc, 'water_temp IS NOT NULL')}) b USING (variable, level)"""
ORACLES["profile_num"] = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {R(f'min({c})', 'min', 9)}, {R(f'max({c})', 'max', 9)}, {R(f'avg({c})', 'mean', 9)}, {R(f'stddev_samp({c})', 'sd', 9)}, count(*) - count({c}) AS n_missing, count(*) AS n, "
    f"{R(_quantile(c, 0.25), 'q1', 9)}, {R(_quantile(c, 0.5), 'median', 9)}, {R(_quantile(c, 0.75), 'q3', 9)} FROM frame" for c in NUMERIC_COVARIATES
)
ORACLES["profile_num_log"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, CASE WHEN hi = lo THEN 1 ELSE CAST(least(10, greatest(1, ceil((x - lo) / ((hi - lo) / 10.0)))) AS INTEGER) END AS bin, count(*) AS n FROM
    (SELECT ln(1 + {c}) AS x, min(ln(1 + {c})) OVER () AS lo, max(ln(1 + {c})) OVER () AS hi FROM frame) WHERE x IS NOT NULL GROUP BY 2"""
    for c in ["aquatic_plant_index", "dry_area", "dry_depth", "visibility", "water_level"]
)
ORACLES["histogram"] = f"SELECT gear, bin, count(*) AS n, {R('bin * 0.1::DOUBLE', 'bin_center')} FROM (SELECT gear, CAST(floor(diversity_alpha / 0.1::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS bin FROM alpha_all) GROUP BY gear, bin"


def boxes(source: str, value: str, by: str, digits: int = 6) -> str:
    return f"""SELECT {by}, {R('q1', 'q1', digits)}, {R('median', 'median', digits)}, {R('q3', 'q3', digits)},
  {R('min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_low', digits)},
  {R('max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_high', digits)},
  count(*) FILTER (NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers, count(*) AS n FROM
  (SELECT {by}, {value} AS x FROM {source} WHERE {value} IS NOT NULL) JOIN
  (SELECT {by}, {_quantile(value, 0.25)} AS q1, {_quantile(value, 0.5)} AS median, {_quantile(value, 0.75)} AS q3 FROM {source} GROUP BY {by}) USING ({by})
  GROUP BY {by}, q1, median, q3"""


ORACLES["boxplot"] = boxes("alpha_all", "diversity_alpha", "gear, occasion")
CTES["visit_long"] = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT refuge, occasion, '{(c[:1].upper() + c[1:]).replace('_', ' ')}' AS title, {c} AS value FROM (SELECT DISTINCT * EXCLUDE (sampling) FROM occasion_info)"
        for c in SEASON_MEASURES
    ) + ")"
)
ORACLES["boxplot_covariates"] = boxes("visit_long", "value", "title, occasion", 9)
ORACLES["diversity_quantiles"] = "SELECT season, " + ", ".join(
    R(_quantile("diversity_alpha", p), n) for n, p in {"q0": 0.0, "q2": 0.02, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q98": 0.98, "q100": 1.0}.items()
) + " FROM frame GROUP BY season"
ORACLES["count_quantiles"] = f"SELECT l_returnflag, {R(_quantile('l_extendedprice', 0.05), 'q5')}, {R(_quantile('l_extendedprice', 0.5), 'q50')}, {R(_quantile('l_extendedprice', 0.95), 'q95')} FROM lineitem GROUP BY l_returnflag"
ORACLES["level_orders"] = """SELECT 'mean' AS summary, occasion AS level, row_number() OVER (ORDER BY avg(diversity_alpha), occasion) AS level_rank FROM frame GROUP BY occasion
  UNION ALL SELECT 'median', occasion, row_number() OVER (ORDER BY quantile_cont(diversity_alpha, 0.5) DESC, occasion) FROM frame GROUP BY occasion
  UNION ALL SELECT 'max', occasion, row_number() OVER (ORDER BY max(diversity_alpha) DESC, occasion) FROM frame GROUP BY occasion
  UNION ALL SELECT 'first', month, row_number() OVER (ORDER BY min(occasion), month) FROM frame GROUP BY month"""
ORACLES["occasion_years"] = "SELECT occasion, CAST((row_number() OVER (ORDER BY occasion) - 1) // 4 AS INTEGER) AS year FROM (SELECT DISTINCT occasion FROM occasion_info)"
ORACLES["water_level_series"] = f"""SELECT refuge, occasion, category_name, CAST(substr(occasion, 3) AS INTEGER) AS occasion_numeric,
  CAST(substr(occasion, 3) AS INTEGER) % 4 IN (2, 3) AS dry_season, {R('ln(1 + rf_water_level)', 'log_water_level')}
  FROM (SELECT DISTINCT * EXCLUDE (sampling) FROM occasion_info) LEFT JOIN (SELECT refuge, category_name FROM refuge_info) USING (refuge)"""
ORACLES["text_formats"] = """SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2) || ' ' || p_type) AS sentence,
  lower(regexp_replace(p_brand || ' & ' || p_type, '[^A-Za-z0-9]+', '_', 'g')) AS snake, substr(p_name, 1, 5) AS short,
  printf('%.1f', round_even(p_retailprice, 1)) AS number, printf('%.1f', round_even(p_size / 64 * 100, 1)) || '%' AS percent,
  CASE WHEN round(p_size / 65536, 3) = 0 THEN '<0.001' ELSE printf('%.3f', round_even(p_size / 65536, 3)) END AS p_text,
  printf('%.2f', round_even(p_size / 4, 2)) || ' [' || printf('%.2f', round_even(p_size / 8, 2)) || ', ' || printf('%.2f', round_even(p_size / 2, 2)) || ']' AS interval,
  CASE p_size % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Earth' WHEN 3 THEN 'Earth & Concrete' END AS channel,
  p_brand || '_' || CASE WHEN p_type = 'PROMO' THEN 'NA' ELSE p_type END AS key, p_name AS stripped FROM part"""
ORACLES["number_transforms"] = f"""SELECT c_custkey, CAST(round_even(c_custkey / 2, 0) AS DOUBLE) AS half_even,
  {R('CASE WHEN c_acctbal > 100 THEN 100 ELSE c_acctbal END', 'capped')},
  {R('CASE WHEN c_acctbal > 0 AND c_acctbal < 10000 THEN ln((c_acctbal / 10000) / (1 - c_acctbal / 10000)) END', 'logit')},
  CAST(CASE WHEN floor(c_acctbal / 10000) = 0 THEN 0.001 ELSE floor(c_acctbal / 10000) END AS DOUBLE) AS nonzero,
  {R('exp(c_acctbal / 10000) - 1', 'pct_change')}, nullif(floor(c_acctbal / 1000), 3) + 0.0 AS sentinel,
  CAST(least(7, greatest(1, ceil((c_acctbal - lo) / ((hi - lo) / 7.0)))) AS INTEGER) AS bin
  FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"""
ORACLES["z_scores"] = f"SELECT c_custkey, {R('(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer)', 'c_acctbal')} FROM customer"
ORACLES["z_score_parameters"] = f"""SELECT c_mktsegment, {R('m', 'c_acctbal_center')}, {R('s', 'c_acctbal_scale')}, {R('max(c_acctbal)', 'largest')} FROM customer,
  (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) GROUP BY c_mktsegment, m, s"""
ORACLES["value_grid"] = f"SELECT CAST(range AS INTEGER) AS point, {R('lo + (hi - lo) * (range / 49)', 's_acctbal')} FROM range(50), (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)"
ORACLES["calendar_labels"] = """SELECT refuge, occasion, CASE month WHEN '2' THEN 'February' WHEN '5' THEN 'May' WHEN '8' THEN 'August' WHEN '11' THEN 'November' END AS month_name,
  CASE year_s WHEN 0 THEN '2013' WHEN 1 THEN '2014' WHEN 2 THEN '2015' ELSE CAST(year_s AS VARCHAR) END AS year_label FROM occasion_covariates"""

_pairs = [(a, b) for i, a in enumerate(NUMERIC_COVARIATES) for b in NUMERIC_COVARIATES[i + 1:]]
_r_p = f"""SELECT col_1, col_2, n, {R('r', 'r')}, {R('CASE WHEN n > 2 AND abs(r) > 1 - 1e-12 THEN 0 WHEN r IS NOT NULL AND n > 2 THEN ' + t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)') + ' END', 'p_value')} FROM """
ORACLES["corr_pearson"] = _r_p + "(" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_1, '{b}' AS col_2, count(*) AS n, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS r FROM frame WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _pairs
) + ")"
ORACLES["corr_spearman"] = _r_p + "(" + " UNION ALL ".join(
    f"""SELECT '{a}' AS col_1, '{b}' AS col_2, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM
    (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y
     FROM spearman_frame WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in _pairs
) + ")"
ORACLES["ols_simple"] = " UNION ALL ".join(
    f"""SELECT '{y}' AS response, CAST(regr_count({y}, m_5) AS BIGINT) AS n, {R(f'regr_intercept({y}, m_5)', 'intercept')}, {R(f'regr_slope({y}, m_5)', 'slope')},
    {R(f'regr_r2({y}, m_5)', 'r_squared')}, {R(f'sqrt(regr_syy({y}, m_5) * (1 - regr_r2({y}, m_5)) / (regr_count({y}, m_5) - 2)) / sqrt(regr_sxx({y}, m_5))', 'slope_se')},
    {R(f'regr_slope({y}, m_5) / (sqrt(regr_syy({y}, m_5) * (1 - regr_r2({y}, m_5)) / (regr_count({y}, m_5) - 2)) / sqrt(regr_sxx({y}, m_5)))', 't')} FROM month_frame""" for y in ("m_8", "m_11")
)
CTES["spearman_frame"] = "SELECT * REPLACE (round(diversity_alpha, 9) AS diversity_alpha) FROM frame"
CTES["month_stats"] = """SELECT month, count(*) AS k, avg(diversity_alpha) AS m FROM frame GROUP BY month"""
CTES["month_sigma"] = """SELECT sum(pow(diversity_alpha - m, 2)) / (count(*) - 4) AS s2, count(*) - 4 AS dof FROM frame JOIN month_stats USING (month)"""
ORACLES["ols_categorical"] = f"""SELECT term, {R('estimate', 'estimate')}, {R('se', 'std_error')}, {R('estimate / se', 't')}, {R(t_p('(estimate / se)', 'dof'), 'p_value')} FROM
  (SELECT 'month_' || a.month AS term, a.m - b.m AS estimate, sqrt(s2 * (1.0 / a.k + 1.0 / b.k)) AS se, dof FROM month_stats a, month_stats b, month_sigma WHERE b.month = '11' AND a.month <> '11'
   UNION ALL SELECT '(Intercept)', m, sqrt(s2 / k), dof FROM month_stats, month_sigma WHERE month = '11')"""
_QUARTILES = {"residual_min": 0, "residual_q1": 0.25, "residual_median": 0.5, "residual_q3": 0.75, "residual_max": 1}
_FITS = {
    "month": ("month", "(SELECT count(DISTINCT month) FROM fit_rows)"),
    "year": ("year", "(SELECT count(DISTINCT year) FROM fit_rows)"),
    "month * year": ("month, year", "(SELECT count(DISTINCT month) * count(DISTINCT year) FROM fit_rows)"),
}
CTES["fit_rows"] = "SELECT CAST(month AS VARCHAR) AS month, CAST(year AS VARCHAR) AS year, diversity_alpha AS y FROM frame WHERE month IS NOT NULL AND year IS NOT NULL AND diversity_alpha IS NOT NULL"
ORACLES["ols_fit"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS model, n, rank, n_aliased, df_residual, {R('1 - rss / tss', 'r_squared')}, {R('1 - rss / tss * (n - 1) / df_residual', 'adj_r_squared')},
    {R('sqrt(rss / df_residual)', 'sigma')}, {R('f', 'f_statistic')}, {R(f_p('f', '(rank - 1)', 'df_residual'), 'p_value')}, {', '.join(R(q, q) for q in _QUARTILES)} FROM
    (SELECT *, n - rank AS df_residual, ((tss - rss) / (rank - 1)) / (rss / (n - rank)) AS f FROM
      (SELECT count(*) AS n, CAST(count(DISTINCT ({by})) AS INTEGER) AS rank, CAST({columns} - count(DISTINCT ({by})) AS INTEGER) AS n_aliased,
        sum(pow(y - m, 2)) AS rss, sum(pow(y - overall, 2)) AS tss, {', '.join(f'{_quantile("y - m", p)} AS {q}' for q, p in _QUARTILES.items())}
       FROM (SELECT *, avg(y) OVER (PARTITION BY {by}) AS m, avg(y) OVER () AS overall FROM fit_rows)))"""
    for name, (by, columns) in _FITS.items()
)
ORACLES["ols_cell_means"] = f"SELECT month, year, count(*) AS n, {R('avg(y)', 'fitted')} FROM fit_rows GROUP BY month, year"
CTES["offset_stats"] = "SELECT month_s, count(*) AS k, avg(diversity_alpha - ln(n_samples)) AS m FROM frame GROUP BY month_s"
CTES["offset_sigma"] = """SELECT sum(pow(diversity_alpha - ln(n_samples) - m, 2)) / (count(*) - 4) AS s2, count(*) - 4 AS dof FROM frame JOIN offset_stats USING (month_s)"""
ORACLES["glm_offset"] = f"""SELECT term, {R('estimate', 'estimate', 5)}, {R('se', 'std_error', 5)}, {R('estimate / se', 't', 5)}, {R(t_p('(estimate / se)', 'dof'), 'p_value', 5)} FROM
  (SELECT 'month_s_' || a.month_s AS term, a.m - b.m AS estimate, sqrt(s2 * (1.0 / a.k + 1.0 / b.k)) AS se, dof FROM offset_stats a, offset_stats b, offset_sigma WHERE b.month_s = 'm_11' AND a.month_s <> 'm_11'
   UNION ALL SELECT '(Intercept)', m, sqrt(s2 / k), dof FROM offset_stats, offset_sigma WHERE month_s = 'm_11')"""
CTES["dry_wet"] = "SELECT m_8 - ln(n_samples) AS y, m_5 AS x FROM month_frame WHERE m_8 IS NOT NULL AND m_5 IS NOT NULL"
CTES["dry_wet_fit"] = """SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) - 2 AS dof, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n,
  (regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) AS s2 FROM dry_wet"""
ORACLES["glm_dry_wet"] = f"""SELECT term, {R('estimate', 'estimate', 5)}, {R('se', 'std_error', 5)}, {R('estimate / se', 't', 5)}, {R(t_p('(estimate / se)', 'dof'), 'p_value', 5)} FROM
  (SELECT 'm_5' AS term, b AS estimate, sqrt(s2 / sxx) AS se, dof FROM dry_wet_fit
   UNION ALL SELECT '(Intercept)', a, sqrt(s2 * (1.0 / n + mx * mx / sxx)), dof FROM dry_wet_fit)"""
_ols_cols = {"(Intercept)": "1.0", **{c: c for c in ["water_level", "aquatic_plant_area", "brush_park", "water_temp", "diversity_alpha"]}}
_ols_names = list(_ols_cols)
ORACLES["ols_moments"] = " UNION ALL ".join(
    f"SELECT '{a}' AS term_1, '{b}' AS term_2, {R(f'CAST(sum({_ols_cols[a]} * {_ols_cols[b]}) AS DOUBLE)', 'total', 4)} FROM frame WHERE water_level IS NOT NULL AND aquatic_plant_area IS NOT NULL AND brush_park IS NOT NULL AND water_temp IS NOT NULL AND diversity_alpha IS NOT NULL"
    for i, a in enumerate(_ols_names) for b in _ols_names[i:]
)
ORACLES["group_means"] = f"SELECT comparison, pa_tr, count(d) AS n, {R('avg(c_stnd - b_stnd)', 'mean')}, {R('stddev_samp(c_stnd - b_stnd) / sqrt(count(d))', 'std_error')} FROM tbi GROUP BY comparison, pa_tr"
CTES["imputed"] = "SELECT " + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in SEASON_MEASURES) + " FROM (SELECT DISTINCT occasion, refuge, " + _cols(SEASON_MEASURES) + " FROM occasion_info)"
ORACLES["pca_corr_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS col_1, '{b}' AS col_2, {R(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)', 'r')} FROM imputed"
    for i, a in enumerate(SEASON_MEASURES) for b in SEASON_MEASURES[i:]
)
ORACLES["ca_inertia"] = f"""SELECT {R('inertia', 'inertia')}, {R('total', 'total')}, n_cells, {R('inertia * total', 'chi_squared')} FROM
  (SELECT sum(x * x / (r * c)) - 1 AS inertia, sum(x) AS total, count(*) AS n_cells FROM
   (SELECT x, sum(x) OVER (PARTITION BY refuge, occasion) AS r, sum(x) OVER (PARTITION BY species) AS c FROM ca_cells))"""
ORACLES["group_ellipse"] = f"""SELECT season, category_name, count(*) AS n, {R('avg(diversity_alpha)', 'mean_x')}, {R('avg(water_level)', 'mean_y')}, {R('var_samp(diversity_alpha)', 'var_x')},
  {R('var_samp(water_level)', 'var_y')}, {R('covar_samp(diversity_alpha, water_level)', 'cov_xy')}, count(*) >= 4 AS enough_points FROM frame WHERE water_level IS NOT NULL GROUP BY season, category_name"""

ORACLES["draw_table"] = f"SELECT draw, param, {R('value', 'value')} FROM drawn WHERE param IN ('click', 'view')"
ORACLES["draw_wide_long"] = " UNION ALL ".join(f"SELECT draw, '{p}' AS param, {R(p, 'value')} FROM draw_wide" for p in ("click", "purchase"))


def intervals(source: str, by: str, widths, point: str = "avg(value)") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, {w}::DOUBLE AS width, {R(point, 'value')}, {R(_quantile('value', round(0.5 - w / 2, 12)), 'lower')}, {R(_quantile('value', round(0.5 + w / 2, 12)), 'upper')} FROM {source} GROUP BY {by}"
        for w in widths
    )


ORACLES["draw_qi"] = intervals("drawn", "param", (0.66, 0.9, 0.95))
ORACLES["draw_qi_median"] = intervals("drawn", "param", (0.66, 0.95), "quantile_cont(value, 0.5)")


def hypothesis(name: str, expr: str, op: str) -> str:
    lo, hi = (0.025, 0.975) if op == "=" else (0.05, 0.95)
    prob = "NULL::DOUBLE" if op == "=" else f"avg(CAST(x {op} 0 AS INTEGER))"
    return (
        f"SELECT '{name}' AS hypothesis, {R('avg(x)', 'estimate')}, {R('stddev_samp(x)', 'std_error')}, {R(_quantile('x', lo), 'lower')}, {R(_quantile('x', hi), 'upper')}, "
        f"{R(prob, 'probability')}, {R(f'{prob} / nullif(1 - {prob}, 0)', 'evidence_ratio')}, count(*) AS n_draws FROM (SELECT {expr} AS x FROM draw_wide) WHERE x IS NOT NULL"
    )


ORACLES["draw_hypothesis"] = " UNION ALL ".join(
    [
        hypothesis("click > view", "click - view", ">"), hypothesis("signup < error", "signup - error", "<"),
        hypothesis("click + view - 2 * error > 0", "click + view - 2 * error", ">"), hypothesis("purchase = 0", "purchase", "="),
    ]
)
ORACLES["draw_pd"] = f"""SELECT param, {R('median', 'median')}, {R('avg(CAST(sign(median) * value > 0 AS INTEGER))', 'pd')} FROM named_params
  JOIN (SELECT param, quantile_cont(value, 0.5) AS median FROM named_params GROUP BY param) USING (param) GROUP BY param, median"""
ORACLES["draw_ratio"] = " UNION ALL ".join(
    f"SELECT draw, '{n}' AS param, {R(f'{a} / nullif({b}, 0)', 'value')} FROM draw_wide WHERE {a} / nullif({b}, 0) IS NOT NULL" for n, a, b in (("click_vs_view", "click", "view"), ("error_vs_signup", "error", "signup"))
)
ORACLES["draw_loss_share"] = f"SELECT draw, {R('click / nullif(click + view, 0)', 'loss_share')}, {R('click + view', 'total')} FROM draw_wide WHERE click IS NOT NULL AND view IS NOT NULL"
ORACLES["draw_r2"] = f"SELECT CAST(l_linenumber AS BIGINT) AS draw, {R('var_samp(l_quantity * 1500) / (var_samp(l_quantity * 1500) + var_samp(l_extendedprice - l_quantity * 1500))', 'value')} FROM lineitem GROUP BY l_linenumber"
CTES["supplier_grid"] = "SELECT CAST(range AS INTEGER) AS point, (lo + (hi - lo) * (range / 4)) / 10000 AS x FROM range(5), (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)"
ORACLES["draw_predict"] = f"SELECT draw, point, {R('x', 'x', 11)}, {R('view + click * x', 'value', 11)} FROM draw_wide, supplier_grid WHERE click IS NOT NULL AND view IS NOT NULL"
CTES["shifted"] = """SELECT r_name AS category, param AS level, view + click * r_regionkey + d.value AS value FROM draw_wide w, region, drawn d
  WHERE click IS NOT NULL AND view IS NOT NULL AND d.draw = w.draw AND d.param IN ('error', 'signup')"""
ORACLES["draw_group_effect"] = intervals("shifted", "category, level", (0.66, 0.95))
ORACLES["draw_broadcast_total"] = f"SELECT draw, param, {R('value', 'value')}, {R('error', 'total_value')} FROM drawn JOIN draw_wide USING (draw)"
ORACLES["draw_sample"] = f"SELECT draw, param, {R('value', 'value')} FROM drawn WHERE {hash32(chr(39) + '0' + chr(39), 'draw::VARCHAR')} < {int(0.1 * 2**32)}"
ORACLES["draw_first"] = f"SELECT draw, param, {R('value', 'value')} FROM drawn WHERE draw <= 999"
CTES["channel_base"] = "SELECT coalesce(min(channel_type) FILTER (channel_type = 'None'), min(channel_type)) AS base FROM tbi_frame"
CTES["slopes"] = "SELECT * FROM named_params WHERE param LIKE 'b_%' AND param NOT LIKE '%Intercept%'"
CTES["slope_intervals"] = intervals("slopes", "param", (0.66, 0.95))
CTES["slope_parsed"] = """SELECT *, regexp_extract(param, '^b_([a-z]+)_', 1) AS response, nullif(regexp_extract(param, '[A-Z].+$'), '') AS level,
  regexp_replace(regexp_replace(param, '^b_[a-z]+_', ''), '[A-Z].+$', '') AS variable FROM slope_intervals"""
ORACLES["effect_sizes"] = """SELECT param, response, variable, level, CASE WHEN level IS NOT NULL THEN base END AS base_level,
  CASE WHEN level IS NULL THEN variable ELSE variable || ' (' || level || ' vs. ' || base || ')' END AS var_level,
  CASE response WHEN 'bstnd' THEN 'Dissimilarity due to losses' WHEN 'cstnd' THEN 'Dissimilarity due to gains' ELSE 'Total dissimilarity' END AS response_label,
  level IS NOT NULL AS categorical, width, value, lower, upper,
  CASE WHEN sign(lower) = sign(value) AND sign(upper) = sign(value) THEN CASE WHEN abs(lower) >= abs(upper) THEN lower ELSE upper END
       WHEN sign(lower) = sign(value) THEN lower WHEN sign(upper) = sign(value) THEN upper END AS label_position FROM slope_parsed, channel_base"""
CTES["effects_sampled"] = f"""SELECT draw, value, regexp_extract(param, '^(.+)\\[', 1) AS random_effect,
  CASE WHEN contains(lv, '_') THEN regexp_extract(lv, '_(.+)$', 1) ELSE lv END AS lv FROM
  (SELECT *, regexp_extract(param, '\\[([^,\\]]+)', 1) AS lv FROM named_effects WHERE {hash32(chr(39) + '0' + chr(39), 'draw::VARCHAR')} < {int(0.5 * 2**32)})"""
ORACLES["group_effect_table"] = f"""SELECT random_effect, upper(substr(lv, 1, 1)) || lower(replace(substr(lv, 2), '_', ' ')) AS name, {R('quantile_cont(value, 0.5)', 'median')}, {R('any_value(es)', 'effect_size')}
  FROM effects_sampled JOIN (SELECT random_effect, quantile_cont(abs(value), 0.5) AS es FROM effects_sampled GROUP BY 1) USING (random_effect) GROUP BY random_effect, lv"""
ORACLES["widest_interval"] = f"SELECT param, {R('avg(value)', 'value')}, {R(_quantile('value', 0.05), 'lower')}, {R(_quantile('value', 0.95), 'upper')} FROM drawn GROUP BY param"

CTES["boot_rows"] = "SELECT *, 1.0 AS x0, gauge_start_m5 AS x1, dist_village AS x2, lwb_area_wet_ha AS x3 FROM tbi_frame WHERE pa_tr = 'no' AND b_stnd IS NOT NULL AND gauge_start_m5 IS NOT NULL AND dist_village IS NOT NULL AND lwb_area_wet_ha IS NOT NULL"
CTES["boot_draws"] = f"SELECT range AS draw FROM range(1, {N_BOOT + 1})"
CTES["boot_weighted"] = f"SELECT draw, {poisson(hash32(chr(39) + '0' + chr(39), 'draw::VARCHAR', 'refuge') + ' / 4294967296.0::DOUBLE')} AS w, b_stnd AS y, x0, x1, x2, x3 FROM boot_rows, boot_draws"
ORACLES["bootstrap_moments"] = " UNION ALL ".join(
    f"SELECT CAST(draw AS INTEGER) AS draw, {i} AS term, {R(f'CAST(sum(w * x{i} * y) AS DOUBLE)', 'xy')}, {R('sum(w * y * y)', 'yy')}, CAST(sum(w) AS BIGINT) AS n FROM boot_weighted GROUP BY draw" for i in range(4)
)


def components(group: str) -> str:
    return f"""SELECT '{group}' AS group_name, k AS n_groups, {R('sqrt(greatest((msb - msw) / n0, 0))', 'sd_between')}, {R('sqrt(msw)', 'sd_within')} FROM
  (SELECT count(*) AS k, sum(n * v) / (sum(n) - count(*)) AS msw, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) AS msb,
    (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM (SELECT {group}, count(*) AS n, avg(diversity_alpha) AS m, var_pop(diversity_alpha) AS v FROM frame GROUP BY {group}))"""


ORACLES["variance_components"] = " UNION ALL ".join(components(g) for g in ("refuge", "category_name", "year_s"))
ORACLES["spread_draws"] = f"""SELECT draw, 'sd_refuge' AS param, {R('sqrt(greatest((msb - msw) / n0, 0))', 'value')} FROM
  (SELECT draw, sum(w * n * v) / nullif(sum(w * n) - sum(w), 0) AS msw, (sum(w * n * m * m) - pow(sum(w * n * m), 2) / nullif(sum(w * n), 0)) / nullif(sum(w) - 1, 0) AS msb,
    (sum(w * n) - sum(w * n * n) / nullif(sum(w * n), 0)) / nullif(sum(w) - 1, 0) AS n0 FROM
    (SELECT *, {poisson(hash32(chr(39) + '0' + chr(39), 'draw::VARCHAR', 'refuge') + ' / 4294967296.0::DOUBLE')} AS w FROM
      (SELECT refuge, count(*) AS n, avg(diversity_alpha) AS m, var_pop(diversity_alpha) AS v FROM frame GROUP BY refuge), boot_draws) GROUP BY draw)"""

# Several factors together: expected sums of squares as a 4 x 4 system, solved by Cramer's rule.
_FACTORS = SPREAD_FACTORS


def determinant(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    minors = [determinant([r[:i] + r[i + 1:] for r in rows[1:]]) for i in range(len(rows))]
    return "(" + " ".join(f"{'-' if i % 2 else '+'} {c} * {m}" for i, (c, m) in enumerate(zip(rows[0], minors))) + ")"


CTES["spread_rows"] = f"""SELECT {', '.join(_FACTORS)}, diversity_alpha - avg(diversity_alpha) OVER () AS y, count(*) OVER () AS n_all FROM frame
  WHERE diversity_alpha IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in _FACTORS)}"""
CTES["spread_system"] = "SELECT n_all, yy, " + ", ".join(f"l{i}, ss{i}, c{i}" for i in range(3)) + ", " + ", ".join(f"k{i}{j}" for i in range(3) for j in range(3)) + (
    " FROM (SELECT any_value(n_all) AS n_all, sum(y * y) AS yy FROM spread_rows)"
    + "".join(f", (SELECT count(*) AS l{i}, sum(s * s / n) AS ss{i}, sum(n * n)::DOUBLE AS c{i} FROM (SELECT count(*) AS n, sum(y) AS s FROM spread_rows GROUP BY {f}))" for i, f in enumerate(_FACTORS))
    + "".join(f", (SELECT sum(n2 / n) AS k{i}{j} FROM (SELECT {f}, sum(n * n)::DOUBLE AS n2, sum(n) AS n FROM (SELECT {f}, {g} AS other, count(*) AS n FROM spread_rows GROUP BY ALL) GROUP BY {f}))" for i, f in enumerate(_FACTORS) for j, g in enumerate(_FACTORS))
)
_left = [[f"(k{i}{j} - c{j} / n_all)" for j in range(3)] + [f"(l{i} - 1)"] for i in range(3)] + [[f"(n_all - c{j} / n_all)" for j in range(3)] + ["(n_all - 1)"]]
_right = [f"ss{i}" for i in range(3)] + ["yy"]
ORACLES["crossed_spread"] = " UNION ALL ".join(
    f"SELECT '{name}' AS component, n_levels, {R('v', 'variance')}, {R('sqrt(greatest(v, 0))', 'sd')} FROM (SELECT {'n_all' if i == 3 else f'l{i}'} AS n_levels, "
    f"{determinant([r[:i] + [b] + r[i + 1:] for r, b in zip(_left, _right)])} / {determinant(_left)} AS v FROM spread_system)"
    for i, name in enumerate([*_FACTORS, "residual"])
)

# The AIC of one- and two-predictor models has a closed form in correlations.
_TB = TBI_PREDICTORS
CTES["subset_rows"] = (
    "SELECT ln(e / (1 - e)) AS y, " + ", ".join(_TB) + " FROM (SELECT *, CASE WHEN d = 0 THEN 0.001 ELSE d END AS e FROM tbi_frame WHERE pa_tr = 'no') WHERE e > 0 AND e < 1 AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in _TB)
)
_models = ["SELECT 'logit_d ~ 1' AS model, 0 AS n_terms, count(*) AS n, var_pop(y) * count(*) AS rss FROM subset_rows"]
_models += [f"SELECT 'logit_d ~ 1 + {a}', 1, count(*), var_pop(y) * count(*) * (1 - pow(corr(y, {a}), 2)) FROM subset_rows" for a in _TB]
_models += [
    f"""SELECT 'logit_d ~ 1 + {a} + {b}', 2, count(*), var_pop(y) * count(*) * (1 - (pow(corr(y, {a}), 2) + pow(corr(y, {b}), 2) - 2 * corr(y, {a}) * corr(y, {b}) * corr({a}, {b})) / (1 - pow(corr({a}, {b}), 2))) FROM subset_rows"""
    for i, a in enumerate(_TB) for b in _TB[i + 1:]
]
CTES["subset_aic"] = "SELECT model, n_terms, n * ln(rss / n) + n * (1 + ln(2 * pi())) + 2 * (n_terms + 2) AS aic FROM (" + " UNION ALL ".join(_models) + ")"
ORACLES["model_weights"] = f"""SELECT model, CAST(n_terms AS INTEGER) AS n_terms, {R('aic', 'aic')}, {R('exp(-0.5 * (aic - lo)) / sum(exp(-0.5 * (aic - lo))) OVER ()', 'weight')}
  FROM subset_aic, (SELECT min(aic) AS lo FROM subset_aic)"""

CTES["visit_covariates"] = """SELECT DISTINCT refuge, occasion, season, month, year_s, water_level, water_temp, visibility, dry_area, dry_depth, category_name
  FROM occasion_covariates LEFT JOIN refuge_covariates USING (refuge)"""
CTES["hellinger"] = "SELECT refuge, occasion, species, sqrt(x / sum(x) OVER (PARTITION BY refuge, occasion)) AS h FROM ca_cells"


def _groups_sql(group: str) -> str:
    """Sums of squares by distances between all pairs of visits of a group, which need no centroid."""
    return f"""SELECT '{group}' AS grouping, n, k, {R('total', 'ss_total')}, {R('within', 'ss_within')}, {R('((total - within) / (k - 1)) / (within / (n - k))', 'pseudo_f')}, {R('(total - within) / total', 'r_squared')}
  FROM (SELECT sum(CASE WHEN a.g = b.g THEN d / a.m END) AS within, sum(d) / any_value(b.n) AS total FROM
    (SELECT v, g, count(*) OVER (PARTITION BY g) AS m FROM (SELECT DISTINCT refuge || occasion AS v, {group} AS g FROM hellinger JOIN visit_covariates USING (refuge, occasion) WHERE {group} IS NOT NULL)) a
    JOIN (SELECT p.refuge || p.occasion AS v1, q.refuge || q.occasion AS v2, 2 - 2 * sum(p.h * q.h) AS d FROM hellinger p JOIN hellinger q ON p.species = q.species AND p.refuge || p.occasion < q.refuge || q.occasion GROUP BY ALL
      UNION ALL SELECT v1, v2, 2 FROM (SELECT a.v AS v1, b.v AS v2 FROM (SELECT DISTINCT refuge || occasion AS v FROM hellinger) a JOIN (SELECT DISTINCT refuge || occasion AS v FROM hellinger) b ON a.v < b.v)
        ANTI JOIN (SELECT DISTINCT p.refuge || p.occasion AS v1, q.refuge || q.occasion AS v2 FROM hellinger p JOIN hellinger q ON p.species = q.species) USING (v1, v2)) ON a.v = v1
    JOIN (SELECT v, g, count(*) OVER () AS n FROM (SELECT DISTINCT refuge || occasion AS v, {group} AS g FROM hellinger JOIN visit_covariates USING (refuge, occasion) WHERE {group} IS NOT NULL)) b ON b.v = v2),
   (SELECT count(DISTINCT refuge || occasion) AS n, count(DISTINCT {group}) AS k FROM hellinger JOIN visit_covariates USING (refuge, occasion) WHERE {group} IS NOT NULL)"""


ORACLES["composition_groups"] = _groups_sql("season") + " UNION ALL " + _groups_sql("category_name")
CTES["cca_cells"] = "SELECT refuge, occasion, species, x, water_level AS a, dry_area AS b FROM ca_cells JOIN visit_covariates USING (refuge, occasion) WHERE water_level IS NOT NULL AND dry_area IS NOT NULL"
CTES["cca_centred"] = """SELECT species, x / t AS p, a - ma AS a, b - mb AS b FROM cca_cells,
  (SELECT sum(x) AS t, sum(x * a) / sum(x) AS ma, sum(x * b) / sum(x) AS mb FROM cca_cells)"""
CTES["cca_moments"] = """SELECT * FROM (SELECT sum(p * a * a) AS gaa, sum(p * a * b) AS gab, sum(p * b * b) AS gbb FROM cca_centred),
  (SELECT sum(ca * ca / c) AS maa, sum(ca * cb / c) AS mab, sum(cb * cb / c) AS mbb FROM (SELECT sum(p) AS c, sum(p * a) AS ca, sum(p * b) AS cb FROM cca_centred GROUP BY species))"""
CTES["cca_fit"] = """SELECT (gbb * maa - 2 * gab * mab + gaa * mbb) / (gaa * gbb - gab * gab) AS t, (maa * mbb - mab * mab) / (gaa * gbb - gab * gab) AS d FROM cca_moments"""
CTES["cca_total"] = """SELECT sum(x * x / (r * c)) - 1 AS total FROM (SELECT x, sum(x) OVER (PARTITION BY refuge, occasion) AS r, sum(x) OVER (PARTITION BY species) AS c FROM cca_cells)"""
ORACLES["cca_inertia"] = f"SELECT {R('total', 'total')}, {R('t', 'constrained')}, {R('total - t', 'residual')}, {R('t / total', 'share')} FROM cca_fit, cca_total"
ORACLES["cca_axes"] = " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS axis, {R(f'(t {sign} sqrt(t * t - 4 * d)) / 2', 'eigenvalue')}, {R(f'(t {sign} sqrt(t * t - 4 * d)) / 2 / t', 'share')} FROM cca_fit"
    for k, sign in ((1, "+"), (2, "-"))
)
CTES["rda_sites"] = """SELECT a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, avg(a) OVER () AS ma, avg(b) OVER () AS mb FROM
  (SELECT DISTINCT refuge, occasion, water_level AS a, dry_area AS b FROM hellinger JOIN visit_covariates USING (refuge, occasion) WHERE water_level IS NOT NULL AND dry_area IS NOT NULL)"""
CTES["rda_cells"] = """SELECT species, h, water_level - ma AS a, dry_area - mb AS b FROM hellinger JOIN visit_covariates USING (refuge, occasion), (SELECT any_value(ma) AS ma, any_value(mb) AS mb FROM rda_sites)
  WHERE water_level IS NOT NULL AND dry_area IS NOT NULL"""
CTES["rda_fit"] = """SELECT n, maa / gaa / ss AS ra, mbb / gbb / ss AS rb, (gbb * maa - 2 * gab * mab + gaa * mbb) / (gaa * gbb - gab * gab) / ss AS rab FROM
  (SELECT count(*) AS n, sum(a * a) AS gaa, sum(a * b) AS gab, sum(b * b) AS gbb FROM rda_sites),
  (SELECT sum(ca * ca) AS maa, sum(ca * cb) AS mab, sum(cb * cb) AS mbb FROM (SELECT sum(h * a) AS ca, sum(h * b) AS cb FROM rda_cells GROUP BY species)),
  (SELECT sum(hh - s * s / (SELECT count(*) FROM rda_sites)) AS ss FROM (SELECT sum(h * h) AS hh, sum(h) AS s FROM rda_cells GROUP BY species))"""
CTES["rda_adjusted"] = """SELECT *, 1 - (1 - ra) * (n - 1) / (n - 2) AS aa, 1 - (1 - rb) * (n - 1) / (n - 2) AS ab, 1 - (1 - rab) * (n - 1) / (n - 3) AS aab FROM rda_fit"""
ORACLES["variation_pair"] = " UNION ALL ".join(
    f"SELECT '{part}' AS part, '{kind}' AS kind, CAST({terms} AS INTEGER) AS n_terms, {R(f'CAST({r2} AS DOUBLE)', 'r_squared')}, {R(adjusted, 'adj_r_squared')} FROM rda_adjusted"
    for part, kind, terms, r2, adjusted in (
        ("visit", "union", "1", "ra", "aa"), ("site", "union", "1", "rb", "ab"), ("visit + site", "union", "2", "rab", "aab"),
        ("visit", "fraction", "NULL", "NULL", "aab - ab"), ("site", "fraction", "NULL", "NULL", "aab - aa"),
        ("visit + site", "fraction", "NULL", "NULL", "aa + ab - aab"), ("residual", "fraction", "NULL", "NULL", "1 - aab"),
    )
)
CTES["judged"] = """SELECT refuge, species, coalesce(x, 0) AS x FROM (SELECT DISTINCT refuge FROM ca_cells) r CROSS JOIN (SELECT DISTINCT species FROM ca_cells) s
  LEFT JOIN (SELECT refuge, species, round(sum(x), 9) AS x FROM ca_cells GROUP BY ALL) USING (refuge, species)"""
CTES["judge_ranks"] = """SELECT refuge, species, rank() OVER (PARTITION BY species ORDER BY x) + (count(*) OVER (PARTITION BY species, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY species, x) AS t FROM judged"""
CTES["agreement"] = """SELECT n, m, 12 * s / (m * m * (pow(n, 3) - n) - m * ties) AS w FROM
  (SELECT count(DISTINCT refuge) AS n, count(DISTINCT species) AS m, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM judge_ranks),
  (SELECT var_pop(s) * count(*) AS s FROM (SELECT sum(rk) AS s FROM judge_ranks GROUP BY refuge))"""
ORACLES["concordance"] = f"SELECT n AS n_objects, m AS n_judges, {R('w', 'w')}, {R('m * (n - 1) * w', 'chi_squared')}, {R('(m - 1) * w / (1 - w)', 'f_statistic')} FROM agreement"
CTES["hill"] = """SELECT refuge, occasion, gear, count(*) AS richness, exp(-sum(p * ln(p))) AS hill_1, 1 / sum(p * p) AS hill_2 FROM
  (SELECT refuge, occasion, gear, no_fish / sum(no_fish) OVER (PARTITION BY refuge, occasion, gear) AS p FROM std_totals WHERE no_fish > 0) GROUP BY ALL"""
ORACLES["evenness"] = f"""SELECT refuge, occasion, gear, richness, {R('hill_1', 'hill_1')}, {R('hill_2', 'hill_2')}, {R('hill_1 / richness', 'shannon_evenness')},
  {R('hill_2 / richness', 'simpson_evenness')}, {R('hill_2 / hill_1', 'hill_ratio')} FROM hill"""
CTES["season_totals"] = "SELECT season, refuge || occasion AS v, species, no_fish, total_weight FROM mean_totals JOIN (SELECT DISTINCT refuge, occasion, season FROM occasion_covariates) USING (refuge, occasion) WHERE gear = 'GN'"
CTES["importance"] = """SELECT season, species, 100 * sum(no_fish) / any_value(nn) AS np, 100 * sum(total_weight) / any_value(ww) AS wp, 100.0 * count(*) FILTER (no_fish > 0) / any_value(vv) AS fp FROM season_totals
  JOIN (SELECT season, sum(no_fish) AS nn, sum(total_weight) AS ww, count(DISTINCT v) AS vv FROM season_totals GROUP BY season) USING (season) GROUP BY season, species"""
ORACLES["relative_importance"] = f"""SELECT season, species, {R('np', 'number_pct')}, {R('wp', 'weight_pct')}, {R('fp', 'frequency_pct')}, {R('(np + wp) * fp', 'iri')},
  {R('100 * (np + wp) * fp / sum((np + wp) * fp) OVER (PARTITION BY season)', 'iri_pct')} FROM importance"""


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
