"""SQL side of the checks: shared bindings as CTEs, and generated quantile text."""

from __future__ import annotations

import re

from workload.bindings import CATEGORIES, COUNTRY, FUELS, RAW, SQL


def lit(p: float) -> str:
    return f"{p!r}e0"


def quantile_sql(src: str, x: str, w: str, probs, names, by=(), mean: str | None = None, places: int = 9) -> str:
    """Exact weighted quantiles by a plain sorted running sum per group."""
    by = list(by)
    g = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    picks, out = [], []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        h = f"(1 + (n - 1) * {lit(p)})"
        lo = f"greatest(floor({h}), 1e0)"
        picks.append(f"coalesce(min(CASE WHEN cw >= {lo} THEN x END), max(x)) AS lo{i}")
        picks.append(f"coalesce(min(CASE WHEN cw >= least({lo} + 1, n) THEN x END), max(x)) AS hi{i}")
        out.append(f"lo{i} + ({h} - floor({h})) * (hi{i} - lo{i}) AS {name}")
    if mean:
        picks.append("max(sx) AS sx")
        out.append(f"sx / n AS {mean}")
    picked = ", ".join(picks)
    return f"""
      SELECT {g}{", ".join(out)} FROM (
        SELECT {g}max(n) AS n, {picked} FROM (
          SELECT {g}x, CAST(sum(w) OVER ({part} ORDER BY x ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cw,
            CAST(sum(w) OVER ({part}) AS DOUBLE) AS n, sum(CAST(w AS DOUBLE) * x) OVER ({part}) AS sx
          FROM (SELECT {g}{x} AS x, sum(CAST({w} AS DECIMAL({20 + places if places < 18 else 38}, {places}))) AS w FROM ({src}) AS src
                WHERE {x} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND {w} > 0 GROUP BY {g}{x}) AS ties
        ) AS running {group}
      ) AS picked"""


BOX = ([0.05, 0.25, 0.5, 0.75, 0.95], ["y5", "y25", "y50", "y75", "y95"])


def box_sql(src: str, x: str, w: str, by=()) -> str:
    return quantile_sql(src, x, w, *BOX, by, mean="mean")


def bin_names(ks):
    return sorted({i / k for k in ks for i in range(1, k)})


def bins_sql(src: str, x: str, w: str, ks, prefix: str, keep: str) -> str:
    """Rows of ``src`` with their weighted bins; equal breaks count once."""
    probs = bin_names(ks)
    names = [f"b{i}" for i in range(len(probs))]
    at = dict(zip(probs, names, strict=True))
    stats = quantile_sql(src, x, w, [0.0, *probs, 1.0], ["bmin", *names, "bmax"])
    cols = []
    for k in ks:
        inner = ", ".join(
            f"CASE WHEN {b} > bmin AND {b} < bmax AND {x} > {b} THEN {b} END"
            for b in (at[i / k] for i in range(1, k))
        )
        cols.append(
            f"CASE WHEN {x} IS NOT NULL THEN 1 + len(list_distinct([{inner}])) END AS {prefix}{k}"
        )
    return f"SELECT {keep}, {', '.join(cols)} FROM ({src}) AS src, ({stats}) AS breaks"


_T = {"global": "CO2_Mt", "national": "CO2_Mt_within", "electricity": "CO2_Mt_Electricity", "transport": "CO2_Mt_Transport"}
_MERGE = "CASE WHEN GTAP IN ('gas', 'gdt') THEN 'gasgdt' ELSE GTAP END"
_WLINES = "SELECT * FROM wlines"
_KS = (2, 3, 5, 10)

CTES = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in SQL.items()}
CTES |= {
    "sector_map": f"""SELECT item_code, {_MERGE} AS GTAP FROM (
        SELECT s.GTAP, u.item_code FROM sector_sheet s, unnest([c1, c2, c3, c4, c5, c6]) AS u(item_code))
        WHERE item_code IS NOT NULL""",
    "categories": "SELECT * FROM category_sheet WHERE category IS NOT NULL",
    "intensity": f"""SELECT GTAP, {", ".join(f"sum({c}) / sum(Total_HH_Consumption_MUSD) AS i_{n}" for n, c in _T.items())}
        FROM (SELECT {_MERGE.replace("GTAP", "s.GTAP")} AS GTAP, {", ".join(f"e.{c}" for c in _T.values())},
              e.Total_HH_Consumption_MUSD FROM sectors s LEFT JOIN emissions e ON s.Number = e.GTAP) GROUP BY GTAP""",
    "lines": "SELECT i.hh_id, c.item_code, i.expenditures_year FROM items i JOIN codes c USING (coicop)",
    "wlines": """SELECT l.hh_id, l.item_code, l.expenditures_year, h.hh_weights
        FROM lines l LEFT JOIN hh h USING (hh_id) WHERE l.expenditures_year > 0""",
    "caps": quantile_sql(_WLINES, "expenditures_year", "hh_weights", [0.99, 0.5], ["cap", "mid"], ["item_code"]),
    "cleaned": """SELECT w.hh_id, w.item_code, w.hh_weights,
          CASE WHEN w.expenditures_year >= c.cap THEN c.mid ELSE w.expenditures_year END AS expenditures
        FROM wlines w LEFT JOIN caps c USING (item_code)""",
    "secexp": "SELECT c.*, s.GTAP FROM cleaned c JOIN sector_map s USING (item_code) WHERE s.GTAP <> 'deleted'",
    "rate": f"SELECT TRY_CAST(exchange_rate AS DOUBLE) AS r FROM fx WHERE Country = '{COUNTRY}'",
    "per_sector": """SELECT hh_id, GTAP, sum(expenditures) AS expenditures,
          sum(expenditures) * (SELECT r FROM rate) AS expenditures_USD_2014 FROM secexp GROUP BY hh_id, GTAP""",
    "usd_totals": """SELECT hh_id, sum(expenditures) AS hh_expenditures,
          sum(expenditures_USD_2014) AS hh_expenditures_USD_2014 FROM per_sector GROUP BY hh_id""",
    "fp": f"""SELECT p.hh_id, max(t.hh_expenditures_USD_2014) AS hh_expenditures_USD_2014,
          {", ".join(f"sum(p.expenditures_USD_2014 * i.i_{n}) AS CO2_t_{n}" for n in _T)}
        FROM per_sector p JOIN intensity i USING (GTAP) JOIN usd_totals t USING (hh_id)
        WHERE p.GTAP <> 'other' GROUP BY p.hh_id""",
    "inc": f"""SELECT *, {", ".join(f"CO2_t_{n} * 30 AS exp_CO2_{n}" for n in _T)},
          {", ".join(f"CO2_t_{n} * 30 / hh_expenditures_USD_2014 AS burden_CO2_{n}" for n in _T)} FROM fp""",
    "hhpc": """SELECT t.hh_id, t.hh_expenditures, t.hh_expenditures / h.hh_size AS hh_expenditures_pc, h.hh_weights
        FROM usd_totals t LEFT JOIN hh h USING (hh_id)""",
    "bins": bins_sql("SELECT * FROM hhpc", "hh_expenditures_pc", "hh_weights", _KS, "Income_Group_",
                     "hh_id, hh_expenditures, hh_expenditures_pc"),
    "cat_sums": f"""SELECT hh_id, sum(expenditures) AS total,
          {", ".join(f"coalesce(sum(expenditures) FILTER (category = '{c}'), 0) AS c_{c}" for c in CATEGORIES)}
        FROM cleaned JOIN categories USING (item_code)
        WHERE category NOT IN ('deleted', 'in-kind', 'self-produced') GROUP BY hh_id""",
    "shares": f"SELECT hh_id, {', '.join(f'c_{c} / total AS share_{c}' for c in CATEGORIES)} FROM cat_sums",
    "fuel_sums": f"""SELECT hh_id, {", ".join(f"sum(expenditures) FILTER (fuel = '{f}') AS exp_LCU_{f}" for f in FUELS)}
        FROM cleaned JOIN fuel_pairs USING (item_code) GROUP BY hh_id""",
    "heads": "SELECT hh_id, education_hhh FROM persons WHERE relationhhh <= 1",
    "members": """SELECT coalesce(p.hh_id, a.hh_id) AS hh_id, p.education_hhh, a.own_stove, a.own_vehicle
        FROM heads p FULL JOIN assets a ON p.hh_id = a.hh_id""",
    "frame": """SELECT coalesce(h.hh_id, m.hh_id) AS hh_id, h.* EXCLUDE (hh_id), m.* EXCLUDE (hh_id)
        FROM hh h FULL JOIN members m ON h.hh_id = m.hh_id""",
    "mart": """SELECT i.*, b.* EXCLUDE (hh_id), s.* EXCLUDE (hh_id), f.* EXCLUDE (hh_id), h.* EXCLUDE (hh_id)
        FROM inc i LEFT JOIN bins b USING (hh_id) LEFT JOIN shares s USING (hh_id)
        LEFT JOIN fuel_sums f USING (hh_id) LEFT JOIN frame h USING (hh_id)""",
}


def _uses(text: str, known: dict[str, str]) -> set[str]:
    return {w for w in re.findall(r"\b[a-zA-Z_]\w*\b", text) if w in known and w not in RAW}


def _ordered(names: set[str], known: dict[str, str], done: list[str]) -> None:
    for n in sorted(names):
        if n not in done:
            _ordered(_uses(known[n], known) - {n}, known, done)
            if n not in done:
                done.append(n)


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with every binding it (transitively) needs in front; extra ones add to or replace the shared."""
    known, order = {**CTES, **(extra or {})}, []
    _ordered(_uses(body, known) | set(extra or {}), known, order)
    # read several times and costly: compute once
    parts = [f"{n} AS MATERIALIZED ({known[n]})" for n in order]
    return f"WITH {', '.join(parts)} {body}" if parts else body
