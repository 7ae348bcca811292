"""SQL for another engine that answers each registered query from the same input tables, written apart from the Spark code."""

from __future__ import annotations

from .operators.costs import COMPONENTS, RATES
from .plans.staging import PIN, PIN_NEW, PIN_OLD, steps

AS_OF, LOOKBACK, SPAN = "2000-09-25", 52, 826
DECISIONS = ["1998-03-30", "1999-06-28", "2000-05-29", "2000-10-30"]
BEFORE_ACTIONS = "2002-06-15"
WINDOWS = [("1997-01-06", "1998-06-08"), ("1998-06-08", "2000-09-25"), ("2000-06-05", "2001-08-06")]
GUARD_SPAN, STALE = 210, 210

_ADJ = """
, akeys AS (SELECT m.symbol_id, m.entity_id, unnest(['e:' || m.entity_id::VARCHAR, 't:' || l.ticker]) AS key FROM ({emap}) m JOIN ({label}) l USING (symbol_id)),
abars AS (SELECT k.key, b.date, b.source, k.entity_id, b.close::DOUBLE AS close FROM bars b JOIN akeys k USING (symbol_id) WHERE b.ingested_at <= TIMESTAMP '{pin}' AND b.close > 0
  QUALIFY row_number() OVER (PARTITION BY k.key, b.date, b.source ORDER BY b.ingested_at DESC, b.symbol_id DESC) = 1),
afac AS (SELECT r.key, r.date, r.entity_id, r.close, r.close / e.close AS factor FROM abars r JOIN abars e ON r.key = e.key AND r.date = e.date AND r.source = 'nse-bhavcopy' AND e.source = 'eod2'),
alag AS (SELECT *, lag(factor) OVER w AS pf, lag(close) OVER w AS pc, lag(date) OVER w AS pd FROM afac WINDOW w AS (PARTITION BY key ORDER BY date)),
astep AS (SELECT entity_id, date AS ex_date, pd AS prev_date, pf / factor AS ratio, pc AS prev_close, close, key FROM alag WHERE abs(pf / factor - 1) > 0.02
  QUALIFY row_number() OVER (PARTITION BY entity_id, date ORDER BY key) = 1),
afrac AS (SELECT n AS num, d AS den, n::DOUBLE / d AS v FROM range(1, 21) a(n), range(1, 11) b(d) WHERE n <> d),
adet AS (SELECT s.*, f.num, f.den, f.v AS exact, CASE WHEN f.num IS NULL THEN 'unclassified' WHEN abs(close / prev_close * f.v - 1) <= 0.10 THEN 'share action' ELSE 'uncorroborated' END AS outcome
  FROM astep s LEFT JOIN LATERAL (SELECT * FROM afrac WHERE s.ratio > 0 AND abs(s.ratio - 1) >= 0.09 AND abs(s.ratio / v - 1) <= 0.01 ORDER BY den, num LIMIT 1) f ON true),
adjustments AS (SELECT entity_id, ex_date, exact AS ratio, TIMESTAMP '2002-07-01' AS ingested_at FROM adet WHERE outcome = 'share action')"""


def latest(table: str, key: str, pin: str | None, where: str = "true") -> str:
    seen = f"ingested_at <= TIMESTAMP '{pin}'" if pin else "true"
    return f"SELECT * FROM {table} WHERE {seen} AND {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1"


def emap(pin: str | None) -> str:
    seen = f"WHERE ingested_at <= TIMESTAMP '{pin}'" if pin else ""
    return f"SELECT s.symbol_id, coalesce(l.entity_id, s.symbol_id) AS entity_id FROM (SELECT DISTINCT symbol_id FROM symbols {seen}) s LEFT JOIN ({latest('symbol_links', 'symbol_id', pin)}) l USING (symbol_id)"


def label(day: str, pin: str) -> str:
    return f"SELECT * FROM symbols WHERE ingested_at <= TIMESTAMP '{pin}' QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY CASE WHEN valid_from <= DATE '{day}' THEN 0 ELSE 1 END, CASE WHEN valid_from <= DATE '{day}' THEN valid_from END DESC, valid_from ASC, ingested_at DESC) = 1"


def member(day: str, pin: str) -> str:
    return f"SELECT m.entity_id, m.symbol_id FROM ({emap(pin)}) m LEFT JOIN ({latest('symbol_links', 'symbol_id', pin)}) l USING (symbol_id) QUALIFY row_number() OVER (PARTITION BY m.entity_id ORDER BY coalesce(l.boundary, DATE '0001-01-01') <= DATE '{day}' DESC, l.boundary DESC NULLS LAST, m.symbol_id) = 1"


def elabel(day: str, pin: str) -> str:
    return f"SELECT e.entity_id, e.symbol_id, l.isin, l.ticker FROM ({member(day, pin)}) e JOIN ({label(day, pin)}) l USING (symbol_id)"


def staged(sql: str, actions: bool = False) -> str:
    head = steps("//")
    if actions:
        head += _ADJ.format(emap=emap(PIN), label=latest("symbols", "symbol_id", PIN), pin=PIN)
    return f"{head}{', ' if sql.lstrip().startswith('%') else ' '}{sql.lstrip().removeprefix('%')}"


def f6(x: str) -> str:
    return f"sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6"


def universe(as_of: str = AS_OF, source: str = "nse-bhavcopy", pin: str = PIN, stale: bool = False, equities: bool = False, n: int = 50) -> str:
    live = "true" if stale else "last_seen = (SELECT max(date) FROM days)"
    return staged(f"""%
v AS ({latest('bars', 'symbol_id, date', pin, f"source = '{source}' AND date > DATE '{as_of}' - {SPAN} AND date <= DATE '{as_of}'")}),
days AS (SELECT DISTINCT date FROM v ORDER BY date DESC LIMIT {LOOKBACK}),
per AS (SELECT m.entity_id, median(coalesce(turnover::DOUBLE, close::DOUBLE * volume)) AS med, count(DISTINCT date) AS days_present, count(DISTINCT v.symbol_id) AS fragments, max(date) AS last_seen
  FROM v JOIN ({emap(pin)}) m USING (symbol_id) WHERE series = 'EQ' AND date IN (SELECT date FROM days) GROUP BY 1
  HAVING count(DISTINCT date) >= ceil((SELECT count(*) FROM days) * 0.8) AND {live}),
br AS (SELECT m.entity_id, max(boundary) AS last_break FROM ({latest('symbol_links', 'symbol_id', pin)}) l JOIN ({emap(pin)}) m USING (symbol_id) WHERE boundary <= DATE '{as_of}' GROUP BY 1)
SELECT per.entity_id, e.symbol_id, isin, ticker, {f6('med')} AS median_turnover, days_present, fragments, last_break::VARCHAR AS last_break, (SELECT count(*) FROM days) AS sessions, (SELECT max(date) FROM days)::VARCHAR AS last_session
FROM per JOIN ({elabel(as_of, pin)}) e USING (entity_id) LEFT JOIN br USING (entity_id) {"WHERE isin LIKE 'INE%'" if equities else ""} ORDER BY med DESC NULLS LAST, ticker, per.entity_id LIMIT {n}""")


def walls(pin: str, source: str = "nse-bhavcopy") -> str:
    return f"""b AS (SELECT entity_id, boundary AS date, predecessor AS predecessor_id, symbol_id AS successor_id FROM ({latest('symbol_links', 'symbol_id', pin)}) WHERE boundary IS NOT NULL),
sess AS (SELECT DISTINCT date FROM bars WHERE source = '{source}' AND ingested_at <= TIMESTAMP '{pin}'),
g AS (SELECT b.*, coalesce((SELECT min(date) FROM (SELECT s.date FROM sess s WHERE s.date < b.date AND s.date > b.date - {GUARD_SPAN} ORDER BY s.date DESC LIMIT 5)), b.date) AS guard FROM b),
act AS (SELECT entity_id, ex_date, ratio FROM adjustments WHERE ingested_at <= TIMESTAMP '{pin}')"""


def returns(pin: str, source: str = "nse-bhavcopy") -> str:
    wins = " UNION ALL ".join(f"SELECT {i}::INT AS win, DATE '{a}' AS fd, DATE '{b}' AS td" for i, (a, b) in enumerate(WINDOWS))
    return f"""% win AS ({wins}), {walls(pin, source)},
ent AS (SELECT m.entity_id, v.symbol_id, v.date, v.close::DOUBLE AS close FROM ({latest('bars', 'symbol_id, date', pin, f"source = '{source}'")}) v JOIN ({emap(pin)}) m USING (symbol_id)),
f AS (SELECT win, entity_id, date, close FROM win JOIN ent ON date <= fd AND date > fd - {STALE} QUALIFY row_number() OVER (PARTITION BY win, entity_id ORDER BY date DESC, symbol_id) = 1),
t AS (SELECT win, entity_id, date, close FROM win JOIN ent ON date <= td AND date > td - {STALE} QUALIFY row_number() OVER (PARTITION BY win, entity_id ORDER BY date DESC, symbol_id) = 1),
r AS (SELECT w.win, i.entity_id, f.date AS f_date, f.close AS f_close, t.date AS t_date, t.close AS t_close,
  (SELECT min(g.date) FROM g WHERE g.entity_id = i.entity_id AND f.date < g.date AND t.date >= g.guard AND NOT EXISTS (SELECT 1 FROM act WHERE act.entity_id = g.entity_id AND ex_date BETWEEN g.guard AND g.date)) AS boundary,
  coalesce((SELECT product(ratio) FROM act WHERE act.entity_id = i.entity_id AND ex_date > f.date AND ex_date <= t.date), 1.0) AS ratio
  FROM win w CROSS JOIN (SELECT DISTINCT entity_id FROM ({emap(pin)})) i LEFT JOIN f ON f.win = w.win AND f.entity_id = i.entity_id LEFT JOIN t ON t.win = w.win AND t.entity_id = i.entity_id),
z AS (SELECT *, CASE WHEN f_date IS NULL AND t_date IS NULL THEN 'no close at either end' WHEN f_date IS NULL THEN 'no close at the start' WHEN t_date IS NULL THEN 'no close at the end'
  WHEN f_date = t_date THEN 'one session' WHEN boundary IS NOT NULL THEN 'boundary' WHEN f_close <= 0 THEN 'first close not positive' END AS reason FROM r)"""


def adjusted(pin: str, start: str, end: str, open_start: bool) -> str:
    return f"""% {walls(pin)},
shut AS (SELECT entity_id FROM g WHERE date > DATE '{start}' AND guard <= DATE '{end}' AND NOT EXISTS (SELECT 1 FROM act WHERE act.entity_id = g.entity_id AND ex_date BETWEEN g.guard AND g.date)),
c AS (SELECT m.entity_id, v.date, v.close::DOUBLE AS close FROM ({latest('bars', 'symbol_id, date', pin, f"source = 'nse-bhavcopy' AND date {'>' if open_start else '>='} DATE '{start}' AND date <= DATE '{end}'")}) v JOIN ({emap(pin)}) m USING (symbol_id) WHERE m.entity_id NOT IN (SELECT entity_id FROM shut)),
a AS (SELECT c.*, close * coalesce((SELECT product(ratio) FROM act WHERE act.entity_id = c.entity_id AND ex_date > DATE '{start}' AND ex_date <= c.date), 1.0) AS adjusted FROM c)"""


def _rates() -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({lit(c)}, {lit(p)}, {lit(s)}, {lit(b)}, DATE '{d}', {lit(k)}, {v!r}::DOUBLE, {lit(cap)}, {lit(fl)}, {lit(ok)})" for c, p, s, b, d, k, v, cap, fl, ok in RATES)
    return f"rates(component, rp, rs, rb, since, basis, value, cap, floor_, verified) AS (VALUES {rows})"


def rates_for(trades: str, components: tuple[str, ...]) -> str:
    names = ", ".join(f"'{c}'" for c in components)
    return f"""(SELECT x.*, component, basis, value, cap, floor_, verified, since FROM {trades} x JOIN rates ON component IN ({names}) AND (rp IS NULL OR rp = x.product) AND (rs IS NULL OR rs = x.side) AND (rb IS NULL OR rb = x.broker) AND since <= x.date
  QUALIFY row_number() OVER (PARTITION BY trade_id, component ORDER BY (rp IS NOT NULL)::INT + (rs IS NOT NULL)::INT + (rb IS NOT NULL)::INT DESC, since DESC) = 1)"""


def r2(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)"


def charges(trades: str, turnover: str = "qty::DOUBLE * price") -> str:
    pct = "value * turnover"
    line = r2(f"CASE basis WHEN 'flat' THEN value WHEN 'percent' THEN {pct} WHEN 'capped' THEN greatest(least({pct}, cap), floor_) ELSE 0 END")
    cols = ", ".join(f"max(CASE WHEN component = '{c}' THEN amount END) AS {c}" for c in COMPONENTS)
    return f"""tt AS (SELECT *, {r2(turnover)} AS turnover FROM {trades}),
ln AS (SELECT trade_id, component, verified, CASE WHEN component = 'gst' THEN value ELSE {line} END AS amount FROM {rates_for('tt', COMPONENTS)}),
lw AS (SELECT trade_id, bool_and(verified) AS verified, {cols} FROM ln GROUP BY 1),
lx AS (SELECT tt.*, lw.* EXCLUDE (trade_id, gst), {r2('brokerage + exchange + sebi + ipf')} AS taxable, gst AS gst_rate FROM tt JOIN lw USING (trade_id)),
ly AS (SELECT *, {r2('gst_rate * taxable')} AS gst FROM lx),
lz AS (SELECT *, {r2('taxable + gst + stt + stamp')} AS total FROM ly),
priced_trades AS (SELECT *, {r2("CASE WHEN side = 'sell' THEN -turnover ELSE turnover END + total")} AS net FROM lz)"""


#: Trades of the staged orders: each line a trade of its supplier, bought or sold by its return flag.
TRADES = """trades0 AS (SELECT 'acc' || (l_suppkey % 5)::VARCHAR AS account, CASE WHEN l_orderkey % 2 = 0 THEN 'zerodha' ELSE 'angelone' END AS broker, CASE WHEN l_suppkey % 13 = 6 THEN 'fund' ELSE 'equity' END AS product,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_shipdate AS DATE) AS date, l_suppkey AS scrip, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(max(l_extendedprice) AS DOUBLE) AS total_price FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6),
trades AS (SELECT *, account || '|' || broker || '|' || side || '|' || scrip::VARCHAR || '|' || date::VARCHAR AS trade_id, floor(total_price / qty * 100) / 100 AS price FROM trades0)"""


def oracle_sql() -> dict[str, str]:
    v = latest("bars", "symbol_id, date", PIN, "source = 'nse-bhavcopy'")
    bar_cols = "symbol_id, date::VARCHAR AS date, source, ingested_at::VARCHAR AS ingested_at, series, close::DOUBLE AS close, volume, turnover::DOUBLE AS turnover"
    out = {
        "bars_latest_at_pin": staged(f"SELECT {bar_cols} FROM ({latest('bars', 'source, symbol_id, date', PIN)})"),
        "bars_unpinned_latest": staged(f"SELECT {bar_cols} FROM ({latest('bars', 'source, symbol_id, date', None)})"),
        "symbols_latest": staged(f"SELECT symbol_id, isin, ticker, valid_from::VARCHAR AS valid_from FROM ({latest('symbols', 'symbol_id', PIN)})"),
        "label_as_of": staged(f"SELECT symbol_id, isin, ticker, valid_from::VARCHAR AS valid_from FROM ({label(AS_OF, PIN)})"),
        "label_prehistory_fallback": staged(f"SELECT symbol_id, isin, ticker, valid_from::VARCHAR AS valid_from FROM ({label('0001-01-01', PIN)})"),
        "entity_map_at_pin": staged(emap(PIN)),
        "entity_map_before_links": staged(emap("2002-01-01")),
        "entity_map_after_retractions": staged(emap(PIN_NEW)),
        "entity_member_in_force": staged(member("1997-10-01", PIN)),
        "entity_label": staged(elabel(AS_OF, PIN)),
        "sessions_range": staged(f"SELECT DISTINCT date::VARCHAR AS date FROM bars WHERE source = 'eod2' AND date BETWEEN DATE '1997-01-06' AND DATE '1999-12-27' AND ingested_at <= TIMESTAMP '{PIN}'"),
        "bars_for_date": staged(f"SELECT m.entity_id, v.symbol_id, e.isin, e.ticker, v.date::VARCHAR AS date, series, close::DOUBLE AS close, volume, turnover::DOUBLE AS turnover FROM ({v}) v JOIN ({emap(PIN)}) m ON v.symbol_id = m.symbol_id JOIN ({elabel(AS_OF, PIN)}) e ON e.entity_id = m.entity_id WHERE v.date = DATE '{AS_OF}'"),
        "universe_default": universe(),
        "universe_allow_stale": universe(stale=True),
        "universe_equities_only": universe(equities=True),
        "universe_eod2": universe(source="eod2"),
        "universe_at_new_pin": universe(pin=PIN_NEW),
        "universe_at_old_pin": universe(pin=PIN_OLD),
        "universe_across_split": universe(as_of="1998-06-08"),
        "universe_window_size": staged(f"SELECT count(*) AS sessions, max(date)::VARCHAR AS last_session FROM (SELECT DISTINCT date FROM bars WHERE source = 'nse-bhavcopy' AND ingested_at <= TIMESTAMP '{PIN}' AND date > DATE '{AS_OF}' - {SPAN} AND date <= DATE '{AS_OF}' ORDER BY date DESC LIMIT {LOOKBACK})"),
        "boundaries": staged(f"SELECT l.entity_id, boundary::VARCHAR AS date, predecessor AS predecessor_id, l.symbol_id AS successor_id, p.isin AS predecessor_isin, s.isin AS successor_isin FROM ({latest('symbol_links', 'symbol_id', PIN)}) l LEFT JOIN ({latest('symbols', 'symbol_id', PIN)}) p ON p.symbol_id = predecessor LEFT JOIN ({latest('symbols', 'symbol_id', PIN)}) s ON s.symbol_id = l.symbol_id WHERE boundary IS NOT NULL"),
        "guard_starts": staged(f"% {walls(PIN)} SELECT DISTINCT date::VARCHAR AS date, guard::VARCHAR AS guard FROM g", True),
        "endpoint_closes": staged(returns(PIN) + f" SELECT win AS \"window\", entity_id, f_date::VARCHAR AS f_date, {f6('f_close')} AS f_close, t_date::VARCHAR AS t_date, {f6('t_close')} AS t_close FROM z WHERE f_date IS NOT NULL OR t_date IS NOT NULL", True),
        "returns_status": staged(returns(PIN) + " SELECT win AS \"window\", entity_id, CASE WHEN reason IS NULL THEN 'priced' WHEN reason = 'boundary' THEN 'refused' ELSE 'absent' END AS status, reason FROM z", True),
        "returns_before_actions": staged(returns(BEFORE_ACTIONS) + " SELECT win AS \"window\", entity_id, CASE WHEN reason IS NULL THEN 'priced' WHEN reason = 'boundary' THEN 'refused' ELSE 'absent' END AS status, CASE WHEN reason = 'boundary' THEN boundary END::VARCHAR AS boundary FROM z", True),
        "returns_priced": staged(returns(PIN) + f" SELECT win AS \"window\", entity_id, {f6('ratio')} AS ratio, {f6('t_close * ratio / f_close - 1.0')} AS \"return\" FROM z WHERE reason IS NULL", True),
        "closes_back_adjusted": staged(adjusted(PIN, "1997-01-06", "1998-12-28", False) + f" SELECT entity_id, date::VARCHAR AS date, close, {f6('adjusted')} AS adjusted FROM a", True),
        "volatility_annualised": staged(adjusted(PIN, "1997-01-06", "2000-09-25", True) + f", l AS (SELECT entity_id, ln(adjusted / lag(adjusted) OVER (PARTITION BY entity_id ORDER BY date)) AS r FROM a WHERE adjusted > 0) SELECT entity_id, count(r) AS returns, CASE WHEN count(r) >= 60 THEN {f6('stddev_samp(r) * sqrt(252)')} END AS volatility FROM l GROUP BY 1", True),
        "volatility_status": staged(
            adjusted(PIN, "1997-01-06", "2000-09-25", True)
            + f", l AS (SELECT entity_id, ln(adjusted / lag(adjusted) OVER (PARTITION BY entity_id ORDER BY date)) AS r FROM a WHERE adjusted > 0), k AS (SELECT entity_id, count(r) AS n, stddev_samp(r) * sqrt(252) AS v FROM l GROUP BY 1),"
            f" sb AS (SELECT entity_id, min(date) AS boundary FROM g WHERE date > DATE '1997-01-06' AND guard <= DATE '2000-09-25' AND entity_id IN (SELECT entity_id FROM shut) AND NOT EXISTS (SELECT 1 FROM act WHERE act.entity_id = g.entity_id AND ex_date BETWEEN g.guard AND g.date) GROUP BY 1)"
            f" SELECT e.entity_id, CASE WHEN n >= 60 THEN {f6('v')} END AS volatility, coalesce(n, 0) AS returns, boundary::VARCHAR AS boundary, CASE WHEN boundary IS NOT NULL THEN 'boundary' WHEN coalesce(n, 0) = 0 THEN 'no bars in the window'"
            f" WHEN n < 60 THEN 'only ' || n || ' usable returns in the window' END AS reason FROM (SELECT DISTINCT entity_id FROM ({emap(PIN)})) e LEFT JOIN k USING (entity_id) LEFT JOIN sb USING (entity_id)", True),
        "factor_steps": staged(f"SELECT entity_id, ex_date::VARCHAR AS ex_date, prev_date::VARCHAR AS prev_date, {f6('ratio')} AS ratio, prev_close, close, key FROM astep", True),
        "share_actions": staged(f"SELECT entity_id, ex_date::VARCHAR AS ex_date, {f6('ratio')} AS ratio, num::INT AS num, den::INT AS den, outcome FROM adet", True),
        "detection_summary": staged("SELECT count(*) AS steps, count(*) FILTER (outcome = 'unclassified') AS unclassified, count(*) FILTER (outcome = 'uncorroborated') AS uncorroborated, count(*) FILTER (outcome = 'share action') AS share_actions FROM adet", True),
        "actions_between_product": staged(f"SELECT entity_id, count(*) AS actions, {f6('product(ratio)')} AS product FROM adjustments WHERE ex_date > DATE '1997-01-06' AND ex_date <= DATE '1998-06-08' GROUP BY 1", True),
        "action_coverage": staged(f"SELECT count(*) FILTER (raw AND adj) AS both, count(*) FILTER (raw AND NOT adj) AS unadjusted_only FROM (SELECT entity_id, bool_or(source = 'nse-bhavcopy') AS raw, bool_or(source = 'eod2') AS adj FROM bars JOIN ({emap(PIN)}) USING (symbol_id) WHERE ingested_at <= TIMESTAMP '{PIN}' GROUP BY 1)"),
        "index_closes": staged("SELECT date::VARCHAR AS date, close::DOUBLE AS close FROM index_levels WHERE date BETWEEN DATE '1997-12-01' AND DATE '1998-02-01'"),
        "index_name_changes": staged(f"%n AS (SELECT *, lag(date) OVER w AS pd, lag(index_name) OVER w AS pn, lag(close::DOUBLE) OVER w AS pc FROM index_levels WINDOW w AS (ORDER BY date)), j AS (SELECT *, date - pd AS gap, close::DOUBLE / pc - 1.0 AS jump FROM n WHERE upper(regexp_replace(trim(index_name), '\\s+', ' ', 'g')) <> upper(regexp_replace(trim(pn), '\\s+', ' ', 'g'))) SELECT index_code, date::VARCHAR AS date, pn AS prev_index_name, index_name, gap::BIGINT AS gap_days, {f6('jump')} AS jump, CASE WHEN gap > 5 THEN 'UNVERIFIABLE' WHEN abs(jump) > 0.06 THEN 'REBASED' ELSE 'CONTINUOUS' END AS verdict FROM j"),
        "index_gaps": staged("SELECT index_code, pd::VARCHAR AS after, date::VARCHAR AS until, (date - pd)::BIGINT AS gap_days FROM (SELECT index_code, date, lag(date) OVER (ORDER BY date) AS pd FROM index_levels) WHERE date - pd > 5"),
        "calendar_agreement": staged("SELECT count(*) FILTER (a.date IS NOT NULL AND b.date IS NOT NULL) AS both, count(*) FILTER (b.date IS NULL) AS first_only, count(*) FILTER (a.date IS NULL) AS second_only FROM (SELECT DISTINCT date FROM bars WHERE source = 'nse-bhavcopy') a FULL JOIN (SELECT DISTINCT date FROM index_levels) b USING (date)"),
        "content_hash_change_detect": staged("%h AS (SELECT source, symbol_id, date, ingested_at, sha256(concat_ws('|', symbol_id::VARCHAR, date::VARCHAR, series, open::VARCHAR, high::VARCHAR, low::VARCHAR, close::VARCHAR, volume::VARCHAR, coalesce(turnover::VARCHAR, '-'), '-')) AS content_hash FROM bars) SELECT source, symbol_id, date::VARCHAR AS date, old_hash, content_hash AS new_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source, symbol_id, date ORDER BY ingested_at) AS old_hash FROM h) WHERE old_hash <> content_hash"),
        "trade_charges": f"WITH {_rates()}, {TRADES}, {charges('trades')} SELECT trade_id, turnover, brokerage, stt, exchange, sebi, ipf, stamp, taxable, gst, total, net, verified FROM priced_trades",
        "day_charges": f"WITH {_rates()}, {TRADES}, {charges('trades')}, dsum AS (SELECT account, broker, date, count(*) AS trades, sum(total) AS t, count(DISTINCT CASE WHEN side = 'sell' THEN scrip END) AS scrips_sold FROM priced_trades GROUP BY 1, 2, 3) SELECT account, broker, date::VARCHAR AS date, trades, scrips_sold, {r2('t')} AS charges, {r2("scrips_sold * CASE broker WHEN 'zerodha' THEN 15.34::DOUBLE ELSE 23.6::DOUBLE END")} AS dp FROM dsum",
        "rate_in_force": f"WITH {_rates()}, {TRADES}, q AS (SELECT DISTINCT broker, product, side, DATE '2026-09-07' + (n * 400 - 8000)::INT AS date, broker || product || side || n::VARCHAR AS trade_id FROM trades, range(0, 21) r(n)) SELECT trade_id, component, since::VARCHAR AS since, basis, value, verified FROM {rates_for('q', COMPONENTS)}",
    }
    sized = "sz AS (SELECT DISTINCT b.broker, s.side, (ceil(qty * price / 100) * 100)::BIGINT AS notional FROM trades, (VALUES ('zerodha'), ('angelone')) b(broker), (VALUES ('buy'), ('sell')) s(side))"
    asked = "asked AS (SELECT broker || side || notional::VARCHAR AS trade_id, broker, 'equity' AS product, side, DATE '2026-09-07' AS date, notional, notional::DOUBLE AS price, 1 AS qty FROM sz)"
    dp = "max(CASE broker WHEN 'zerodha' THEN 15.34::DOUBLE ELSE 23.6::DOUBLE END)"
    curve = f"WITH {_rates()}, {TRADES}, {sized}, {asked}, {charges('asked')}, cv AS (SELECT broker, notional, {r2(f'sum(total) + {dp}')} AS cost FROM priced_trades GROUP BY 1, 2)"
    out["round_trip_curve"] = f"{curve} SELECT broker, notional, cost, {f6('cost / notional')} AS share FROM cv"
    out["min_notional_by_broker"] = f"{curve} SELECT broker, min(CASE WHEN cost / notional <= 0.005 THEN notional END) AS min_notional FROM cv GROUP BY 1"
    out |= _identity() | _signals() | _reports()
    return out


def _facts() -> str:
    v = latest("bars", "symbol_id, date", PIN, "source = 'nse-bhavcopy'")
    return f"""% lv AS ({v}), sess AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM lv)),
facts AS (SELECT symbol_id, isin, ticker, fd, ld, fc, lc, a.n AS fn, b.n AS ln FROM (SELECT symbol_id, min(date) AS fd, max(date) AS ld, arg_min(close::DOUBLE, date) AS fc, arg_max(close::DOUBLE, date) AS lc FROM lv GROUP BY 1) JOIN ({latest('symbols', 'symbol_id', PIN)}) USING (symbol_id) JOIN sess a ON a.date = fd JOIN sess b ON b.date = ld),
cand AS (SELECT predecessor, successor, min(generator) AS generator FROM (
  SELECT symbol_id AS predecessor, lead(symbol_id) OVER (PARTITION BY left(isin, 9) ORDER BY fd, symbol_id) AS successor, 'issuer' AS generator FROM facts WHERE isin LIKE 'INE%'
  UNION ALL SELECT symbol_id, lead(symbol_id) OVER (PARTITION BY ticker ORDER BY fd, symbol_id), 'ticker' FROM facts) WHERE successor IS NOT NULL GROUP BY 1, 2),
gat AS (SELECT c.*, p.ld AS last_date, s.fd AS first_date, floor(s.fc / nullif(p.lc, 0) * 1e4 + 0.5) / 1e4 AS ratio, p.isin LIKE 'INE%' AND s.isin LIKE 'INE%' AS g0_equity, left(p.isin, 9) = left(s.isin, 9) AS g1_issuer,
  substr(s.isin, 10, 2)::INT > substr(p.isin, 10, 2)::INT AS g2_serial, p.ld < s.fd AND NOT EXISTS (SELECT 1 FROM lv x JOIN lv y USING (date) WHERE x.symbol_id = c.predecessor AND y.symbol_id = c.successor) AS g3_apart,
  s.fn - p.ln <= 1 AS g4_no_session, NOT EXISTS (SELECT 1 FROM cal WHERE d > p.ld AND d < s.fd AND d NOT IN (SELECT date FROM ingest_log WHERE status IN ('ok', 'no-file'))) AS g4a_settled,
  s.fd - p.ld BETWEEN 1 AND 8 AS g4b_gap, EXISTS (SELECT 1 FROM (VALUES (1.0::DOUBLE), (0.5), (0.4), (0.25), (0.2), (0.1), (0.05), (0.02), (0.01)) b(v) WHERE floor(s.fc / nullif(p.lc, 0) * 1e4 + 0.5) / 1e4 BETWEEN v * 0.75 AND v * 1.25) AS g6_ratio,
  coalesce(c.successor IN (SELECT symbol_id FROM ({latest('symbol_links', 'symbol_id', PIN)}) WHERE reason = 'retraction'), false) AS retracted
  FROM cand c JOIN facts p ON p.symbol_id = c.predecessor JOIN facts s ON s.symbol_id = c.successor),
okk AS (SELECT *, NOT retracted AND g0_equity AND g1_issuer AND g2_serial AND g3_apart AND g4_no_session AND g4a_settled AND g4b_gap AND g6_ratio AS ok FROM gat),
fin AS (SELECT *, NOT (ok AND (count(*) FILTER (ok) OVER (PARTITION BY predecessor) > 1 OR count(*) FILTER (ok) OVER (PARTITION BY successor) > 1)) AS g5_path FROM okk)"""


def _pairs() -> str:
    """Any two symbols: all that the gates measure, with every calendar day to be settled."""
    return f"""{_facts()},
asked AS (SELECT DISTINCT 2 * s AS predecessor, 2 * (s + k) + 1 AS successor FROM (SELECT DISTINCT symbol_id // 2 AS s FROM symbols), (VALUES (-3), (5), (10)) x(k) WHERE s + k >= 0),
due AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS d FROM sess),
holes AS (SELECT d FROM due WHERE d NOT IN (SELECT date FROM ingest_log WHERE status IN ('ok', 'no-file'))),
bars_of AS (SELECT symbol_id, count(*) AS k FROM lv GROUP BY 1),
mp AS (SELECT a.*, p.isin AS pi, s.isin AS si, p.ld, s.fd, p.ln, s.fn, pk.k::BIGINT AS predecessor_bars, sk.k::BIGINT AS successor_bars,
  (SELECT count(*) FROM lv x JOIN lv y USING (date) WHERE x.symbol_id = a.predecessor AND y.symbol_id = a.successor)::BIGINT AS shared_days,
  (SELECT count(*) FROM sess WHERE date > p.ld AND date < s.fd) AS sessions_between, (SELECT count(*) FROM holes WHERE d > p.ld AND d < s.fd)::BIGINT AS unsettled_between,
  s.fd - p.ld AS days_between, floor(s.fc / nullif(p.lc, 0) * 1e4 + 0.5) / 1e4 AS ratio
  FROM asked a JOIN facts p ON p.symbol_id = predecessor JOIN facts s ON s.symbol_id = successor JOIN bars_of pk ON pk.symbol_id = predecessor JOIN bars_of sk ON sk.symbol_id = successor),
mg AS (SELECT *, (SELECT n FROM (VALUES (0, '1/1', 1.0::DOUBLE), (1, '1/2', 0.5), (2, '2/5', 0.4), (3, '1/4', 0.25), (4, '1/5', 0.2), (5, '1/10', 0.1), (6, '1/20', 0.05), (7, '1/50', 0.02), (8, '1/100', 0.01)) b(i, n, v)
  WHERE ratio BETWEEN v * 0.75 AND v * 1.25 ORDER BY abs(ratio - v) / v, i LIMIT 1) AS band, substr(pi, 10, 2) || '->' || substr(si, 10, 2) AS serial,
  pi LIKE 'INE%' AND si LIKE 'INE%' AS g0_equity, left(pi, 9) = left(si, 9) AS g1_issuer, substr(si, 10, 2)::INT > substr(pi, 10, 2)::INT AS g2_serial, ld < fd AND shared_days = 0 AS g3_apart,
  sessions_between = 0 AS g4_no_session, unsettled_between = 0 AS g4a_settled, days_between BETWEEN 1 AND 4 AS g4b_gap FROM mp)
SELECT predecessor, successor, shared_days, sessions_between, unsettled_between, days_between, ratio, band, serial, predecessor_bars, successor_bars, g0_equity, g1_issuer, g2_serial, g3_apart, g4_no_session,
  g4a_settled, g4b_gap, band IS NOT NULL AS g6_ratio, false AS accepted FROM mg"""


_TANGLED = "tangled AS (SELECT 2 * s AS symbol_id, 2 * s + 2 AS entity_id FROM (SELECT DISTINCT symbol_id // 2 AS s FROM symbols) UNION ALL SELECT symbol_id, entity_id FROM symbol_links WHERE ingested_at <= TIMESTAMP '2003-01-01')"
_TMAP = f"tmap AS (SELECT s.symbol_id, coalesce(t.entity_id, s.symbol_id) AS entity_id FROM (SELECT DISTINCT symbol_id FROM symbols WHERE ingested_at <= TIMESTAMP '{PIN}') s LEFT JOIN tangled t USING (symbol_id))"
_RUNS = (
    "SELECT concat_ws('-', 'run', k, y) AS run_id, sha256('{\"top\":' || (k % 3) || '}') AS config_hash, d::VARCHAR AS period_to, (d + (k + 1)::INT)::TIMESTAMP::VARCHAR AS finished_at"
    " FROM (SELECT o_custkey % 10 AS k, year(o_orderdate) AS y, max(o_orderdate::DATE) AS d FROM orders GROUP BY 1, 2)"
)


def _ratio_rows() -> str:
    v = latest("bars", "symbol_id, date", PIN, "source = 'nse-bhavcopy'")
    return f"SELECT DISTINCT floor(close / before * 1e4 + 0.5) / 1e4 AS ratio FROM (SELECT close::DOUBLE AS close, lag(close::DOUBLE) OVER (PARTITION BY symbol_id ORDER BY date) AS before FROM ({v})) WHERE before > 0"


def _trips() -> str:
    """Fills folded in order by recursion: quantity and basis held, and what each sale took out."""
    can = "f.qty >= o.qty AND f.qty <> 0"
    return f"""WITH RECURSIVE {_rates()}, {TRADES}, {charges('trades')},
fills AS (SELECT broker AS run, scrip AS entity_id, date, side, sum(qty)::DOUBLE AS qty, sum(turnover) AS value, sum(total) AS costs, ((date - DATE '1990-01-01') * 2 + (side = 'sell')::INT)::INT AS seq FROM priced_trades GROUP BY 1, 2, 3, 4),
ord AS (SELECT *, row_number() OVER (PARTITION BY run, entity_id ORDER BY seq, side) AS k FROM fills),
fold(run, entity_id, k, qty, basis, seq, exit, sold, proceeds) AS (
  SELECT run, entity_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, NULL::INT, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT run, entity_id FROM ord)
  UNION ALL SELECT f.run, f.entity_id, o.k, CASE WHEN o.side = 'buy' THEN f.qty + o.qty WHEN {can} THEN f.qty - o.qty ELSE f.qty END,
    CASE WHEN o.side = 'buy' THEN f.basis + o.value + o.costs WHEN {can} THEN f.basis - f.basis * o.qty / f.qty ELSE f.basis END, o.seq, o.date,
    CASE WHEN o.side = 'sell' AND {can} THEN f.basis * o.qty / f.qty END, o.value - o.costs
  FROM fold f JOIN ord o ON o.run = f.run AND o.entity_id = f.entity_id AND o.k = f.k + 1),
trips AS (SELECT run, entity_id, seq, exit, sold AS basis, proceeds, proceeds / sold - 1 AS ret FROM fold WHERE sold > 0)"""


def _lane_parts() -> str:
    line = "concat_ws('|', symbol_id::VARCHAR, date::VARCHAR, series, open::VARCHAR, high::VARCHAR, low::VARCHAR, close::VARCHAR, volume::VARCHAR, coalesce(turnover::VARCHAR, '-'), '-')"
    lane = " || ".join(f"lpad(lower(to_hex((sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT)), 15, '0')" for i in range(4))
    return f"%lh AS (SELECT source, date, sha256({line}) AS h FROM ({latest('bars', 'source, symbol_id, date', PIN)})), lp AS (SELECT source, date, count(*) AS rows, {lane} AS digest FROM lh GROUP BY 1, 2)"
_ISINS = "isins AS (SELECT DISTINCT isin FROM symbols UNION ALL SELECT DISTINCT left(isin, 11) || ((substr(isin, 12, 1)::INT + 1) % 10)::VARCHAR FROM symbols)"
_CHECK = """digs AS (SELECT isin, list_reverse(list_transform(string_split(array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''), lambda d: d::INT)) AS r FROM isins)"""


def _identity() -> dict[str, str]:
    v = latest("bars", "symbol_id, date", PIN, "source = 'nse-bhavcopy'")
    early = f"""en AS (SELECT 'T' || s || '-' || ((n - 1 + 7 * s) // (CASE WHEN s % 6 = 0 THEN 40 ELSE 13 + s % 4 END)) AS ticker, s, n, date, close::DOUBLE * (1 + s) AS close
  FROM (SELECT *, symbol_id // 2 AS s FROM ({v})) JOIN cal ON d = date),
ob AS (SELECT ticker, min(n) AS fn, arg_min(close, n) AS fc, max(n) AS ln, arg_max(close, n) AS lc FROM en WHERE n <= 130 GROUP BY 1),
br AS (SELECT ticker, 'INE' || ticker AS isin, min(n) AS fn, arg_min(close, n) AS fc FROM en WHERE n >= 130 AND NOT (s % 6 = 0 AND n < 150) GROUP BY 1),
va AS (SELECT * FROM ob WHERE ticker NOT IN (SELECT ticker FROM br)),
nc AS (SELECT ob.ticker, isin, ob.fn, ob.fc FROM ob JOIN br USING (ticker) WHERE ob.fn > (SELECT min(fn) FROM ob) UNION ALL SELECT ticker, isin, fn, fc FROM br WHERE ticker NOT IN (SELECT ticker FROM ob)),
ca AS (SELECT va.ticker, nc.ticker AS new, isin, nc.fn FROM va JOIN nc ON va.lc > 0 AND nc.fc > 0 AND nc.fn - va.ln BETWEEN 0 AND 5 AND abs(nc.fc / va.lc - 1) <= 0.15),
un AS (SELECT * FROM ca QUALIFY count(*) OVER (PARTITION BY ticker) = 1 AND count(*) OVER (PARTITION BY new) = 1),
rk AS (SELECT ob.ticker, CASE WHEN br.isin IS NOT NULL THEN CASE WHEN br.fn - ob.ln BETWEEN 0 AND 5 THEN 'bridged' ELSE 'quarantined' END WHEN un.isin IS NOT NULL THEN 'renamed' ELSE 'dead' END AS kind, br.isin, un.isin AS new,
  CASE WHEN coalesce(br.fn, un.fn) >= ob.ln THEN coalesce(br.fn, un.fn) - ob.ln END AS gap_sessions FROM ob LEFT JOIN br USING (ticker) LEFT JOIN un USING (ticker))"""
    alias = "(VALUES ('NIFTY50', 'S&P CNX NIFTY'), ('NIFTY50', 'CNX NIFTY'), ('NIFTY50', 'NIFTY 50')) a(code, plain)"
    return {
        "succession_candidates": staged(_facts() + " SELECT * FROM cand"),
        "gate_results": staged(_facts() + " SELECT predecessor, successor, generator, last_date::VARCHAR AS last_date, first_date::VARCHAR AS first_date, g0_equity, g1_issuer, g2_serial, g3_apart, g4_no_session, g4a_settled, g4b_gap, g6_ratio, retracted, g5_path, ok AND g5_path AS accepted FROM fin"),
        "pair_evidence": staged(_pairs()),
        "unlinked_candidates": staged(_facts() + f", um AS ({emap('2002-01-01')}) SELECT predecessor, successor, CASE WHEN a.entity_id = b.entity_id THEN 'stale' WHEN ok AND g5_path THEN 'accepted' ELSE 'quarantined' END AS kind FROM fin LEFT JOIN um a ON a.symbol_id = predecessor LEFT JOIN um b ON b.symbol_id = successor WHERE NOT coalesce(a.entity_id = b.entity_id AND ok AND g5_path, false)"),
        "archive_holes": staged("SELECT d::VARCHAR AS date FROM cal, (SELECT min(date) AS lo, max(date) AS hi, max(fetched_at) AS last FROM ingest_log) WHERE d BETWEEN lo AND hi AND d NOT IN (SELECT date FROM ingest_log WHERE status IN ('ok', 'no-file')) AND last >= d + INTERVAL '42 hours 30 minutes'"),
        "invariant_flatness": staged(f"% {_TANGLED} SELECT a.symbol_id, a.entity_id, b.entity_id AS next_entity FROM tangled a JOIN tangled b ON b.symbol_id = a.entity_id AND b.entity_id <> a.entity_id"),
        "invariant_overlap": staged(f"% {_TANGLED}, {_TMAP}, od AS (SELECT entity_id, source, date FROM bars JOIN tmap USING (symbol_id) WHERE ingested_at <= TIMESTAMP '{PIN}' GROUP BY 1, 2, 3 HAVING count(DISTINCT symbol_id) > 1) SELECT entity_id, count(*) AS days FROM od GROUP BY 1"),
        "invariant_violations": staged(
            f"% {_TANGLED}, {_TMAP}, iv AS (SELECT 'flatness' AS kind, a.entity_id, 'symbol ' || a.symbol_id || ' leads to ' || a.entity_id || ', which leads to ' || b.entity_id AS detail, false AS advisory FROM tangled a JOIN tangled b ON b.symbol_id = a.entity_id AND b.entity_id <> a.entity_id"
            f" UNION ALL SELECT 'overlap', entity_id, count(DISTINCT symbol_id) || ' members have a bar of ' || source || ' on ' || date::VARCHAR, false FROM bars JOIN tmap USING (symbol_id) WHERE ingested_at <= TIMESTAMP '{PIN}' GROUP BY entity_id, source, date HAVING count(DISTINCT symbol_id) > 1"
            f" UNION ALL SELECT 'issuer', entity_id, 'issuers ' || string_agg(DISTINCT left(isin, 9), ', ' ORDER BY left(isin, 9)), true FROM tmap JOIN ({latest('symbols', 'symbol_id', PIN)}) USING (symbol_id) WHERE isin LIKE 'INE%' GROUP BY entity_id HAVING count(DISTINCT left(isin, 9)) > 1) SELECT * FROM iv"),
        "invariant_issuer": staged(f"% {_TANGLED}, {_TMAP} SELECT entity_id, string_agg(DISTINCT left(isin, 9), ', ' ORDER BY left(isin, 9)) AS issuers FROM tmap JOIN ({latest('symbols', 'symbol_id', PIN)}) USING (symbol_id) WHERE isin LIKE 'INE%' GROUP BY 1 HAVING count(DISTINCT left(isin, 9)) > 1"),
        "isin_check_digit": staged(f"% {_ISINS}, {_CHECK} SELECT isin, regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') AS well_formed, list_sum(list_transform(r, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d >= 5 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0 AS check_ok FROM digs"),
        "issuer_prefix_serial": staged(f"% {_ISINS} SELECT isin, left(isin, 9) AS issuer, substr(isin, 10, 2)::INT AS serial FROM isins"),
        "ratio_band": staged(f"%r AS ({_ratio_rows()}), b(place, name, v) AS (VALUES (0, '1/1', 1.0::DOUBLE), (1, '1/2', 0.5), (2, '2/5', 0.4), (3, '1/4', 0.25), (4, '1/5', 0.2), (5, '1/10', 0.1), (6, '1/20', 0.05), (7, '1/50', 0.02), (8, '1/100', 0.01)) SELECT ratio, (SELECT name FROM b WHERE ratio >= v * (1 - 0.25::DOUBLE) AND ratio <= v * (1 + 0.25::DOUBLE) ORDER BY abs(ratio - v) / v, place LIMIT 1) AS band FROM r"),
        "simple_fraction": staged(f"%r AS ({_ratio_rows()}), f AS (SELECT n::INT AS num, d::INT AS den FROM range(1, 21) a(n), range(1, 11) b(d) WHERE n <> d), m AS (SELECT ratio, num, den FROM r JOIN f ON abs(ratio - 1) >= 0.09::DOUBLE AND abs(ratio / (num::DOUBLE / den) - 1) <= 0.01::DOUBLE QUALIFY row_number() OVER (PARTITION BY ratio ORDER BY den, num) = 1) SELECT r.ratio, num, den FROM r LEFT JOIN m USING (ratio)"),
        "slug_codes": staged(f"%nm AS (SELECT index_name, date FROM index_levels UNION ALL SELECT CASE WHEN day(date) = 1 THEN 'CNX  nifty' ELSE 'S&P CNX Nifty' END, date FROM index_levels) SELECT index_name, coalesce(code, nullif(regexp_replace(upper(index_name), '[^A-Z0-9]', '', 'g'), ''), 'UNKNOWN') AS index_code, count(*) AS days FROM nm LEFT JOIN {alias} ON plain = upper(regexp_replace(trim(index_name), '\\s+', ' ', 'g')) GROUP BY 1, 2"),
        "month_windows": staged("SELECT d::VARCHAR AS date, (date_trunc('month', d)::DATE - INTERVAL 1 MONTH + to_days(day(d)::INT - 1))::DATE::VARCHAR AS back_1, (date_trunc('month', d)::DATE - INTERVAL 12 MONTH + to_days(day(d)::INT - 1))::DATE::VARCHAR AS back_12 FROM cal"),
        "pre_isin_bridge": staged(f"SELECT ticker, isin, fd::VARCHAR AS first_date FROM (SELECT DISTINCT symbol_id, ticker, isin FROM symbols WHERE ingested_at <= TIMESTAMP '{PIN}') JOIN (SELECT symbol_id, min(date) AS fd FROM ({v}) GROUP BY 1) USING (symbol_id) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fd, symbol_id) = 1"),
        "pre_isin_resolution": staged(f"% {early} SELECT ticker, kind, CASE kind WHEN 'bridged' THEN isin WHEN 'renamed' THEN new ELSE 'X-NSE-' || upper(trim(ticker)) END AS identity, gap_sessions FROM rk"),
        "snapshot_lanes": staged(f"{_lane_parts()} SELECT source, date::VARCHAR AS date, rows, digest FROM lp"),
        "snapshot_years": staged(
            f"{_lane_parts()} SELECT source, year(date)::INT AS year, sum(rows)::BIGINT AS rows, sha256(string_agg(date::VARCHAR || '|' || rows || '|' || digest, ';' ORDER BY date::VARCHAR || '|' || rows || '|' || digest)) AS digest FROM lp GROUP BY 1, 2"
        ),
        "round_trips": f"{_trips()} SELECT run, entity_id, seq, exit::VARCHAR AS exit, {f6('basis')} AS basis, {f6('proceeds')} AS proceeds, {f6('ret')} AS \"return\" FROM trips",
        "trade_stats": f"{_trips()} SELECT run, count(*) AS trades, {f6('avg(ret)')} AS mean, {f6('coalesce(stddev_samp(ret), 0)')} AS deviation, {f6('avg((ret > 0)::INT::DOUBLE)')} AS win_rate FROM trips GROUP BY 1",
        "prior_runs": f"SELECT * FROM ({_RUNS}) WHERE config_hash = sha256('{{\"top\":1}}')",
        "holdout_runs": f"SELECT * FROM ({_RUNS}) WHERE period_to >= '1997-01-01'",
        "ingest_noop_rerun": staged(f"SELECT run, CASE run WHEN 1 THEN n ELSE 0 END AS rows_added FROM (SELECT count(*) AS n FROM ({v})), (VALUES (1), (2)) r(run)"),
        "close_on_day": staged(f"SELECT ticker, arg_min(close::DOUBLE, symbol_id) AS close FROM ({v}) JOIN (SELECT symbol_id, ticker FROM ({latest('symbols', 'symbol_id', PIN)})) USING (symbol_id) WHERE date = DATE '{AS_OF}' GROUP BY 1"),
    }


def _signals() -> dict[str, str]:
    days = " UNION ALL ".join(f"SELECT DATE '{d}' AS as_of" for d in DECISIONS)
    members = f"""dd AS ({days}), lv AS ({latest('bars', 'symbol_id, date', PIN, "source = 'nse-bhavcopy'")}), ss AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM lv)),
wn AS (SELECT as_of, b.date, b.k = a.k AS last_ FROM dd JOIN ss a ON a.date = as_of JOIN ss b ON b.k > a.k - {LOOKBACK} AND b.k <= a.k),
mp AS (SELECT as_of, m.entity_id, median(coalesce(turnover::DOUBLE, close::DOUBLE * volume)) AS med, count(DISTINCT date) AS present, bool_or(last_) AS live FROM lv JOIN ({emap(PIN)}) m USING (symbol_id) JOIN wn USING (date) WHERE series = 'EQ' GROUP BY 1, 2),
mb AS (SELECT as_of, entity_id, med, row_number() OVER (PARTITION BY as_of ORDER BY med DESC, entity_id) AS place FROM mp WHERE live AND present >= ceil((SELECT count(*) FROM wn WHERE wn.as_of = mp.as_of) * 0.8) QUALIFY place <= 40)"""

    def ranked(formation: int, skip: int, order: str, accounted: bool = False) -> str:
        back = lambda k: f"(date_trunc('month', as_of)::DATE - INTERVAL {k} MONTH + to_days(day(as_of)::INT - 1))::DATE"
        body = returns(PIN)
        wins = f"(SELECT row_number() OVER (ORDER BY as_of) - 1 AS win, as_of, {back(formation)} AS fd, {back(skip)} AS td FROM ({days}))"
        start, end = body.index("win AS ("), body.index("), b AS (")
        if accounted:
            priced = "SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY ret DESC, entity_id)::INT AS rank FROM ca WHERE reason IS NULL"
            every = "ca AS (SELECT mb.as_of, mb.entity_id, z.reason, t_close * ratio / f_close - 1.0 AS ret FROM mb JOIN win USING (as_of) JOIN z ON z.win = win.win AND z.entity_id = mb.entity_id)"
            kind = "CASE WHEN rk.rank IS NOT NULL THEN 'ranked' WHEN ca.reason = 'boundary' THEN 'refused' ELSE 'absent' END"
            tail = f"{members}, {every}, rk AS ({priced}) SELECT ca.as_of::VARCHAR AS as_of, ca.entity_id, rk.rank, {kind} AS status, ca.reason FROM ca LEFT JOIN rk USING (as_of, entity_id)"
            return staged(body[:start] + f"win AS (SELECT * FROM {wins}" + body[end:] + f", {tail}", True)
        return staged(body[:start] + f"win AS (SELECT * FROM {wins}" + body[end:] + f", {members} SELECT as_of::VARCHAR AS as_of, entity_id, {f6('ret')} AS \"return\", row_number() OVER (PARTITION BY as_of ORDER BY ret {order}, entity_id)::INT AS rank FROM (SELECT win.as_of, z.entity_id, t_close * ratio / f_close - 1.0 AS ret FROM z JOIN win ON win.win = z.win JOIN mb ON mb.as_of = win.as_of AND mb.entity_id = z.entity_id WHERE reason IS NULL)", True)

    low_days = adjusted(PIN, "1999-09-25", AS_OF, True)
    uni = universe(n=40)
    core = uni[uni.index("v AS (") :]
    return {
        "rebalance_calendar": staged("% x AS (SELECT d, n, lead(d) OVER (ORDER BY d) AS nx FROM cal) SELECT y.d::VARCHAR AS date FROM x JOIN cal y ON y.n = x.n + 2 WHERE nx IS NOT NULL AND date_trunc('month', x.d) <> date_trunc('month', nx) AND month(x.d) % 3 = 0"),
        "turnover_rank": staged(f"% {members} SELECT as_of::VARCHAR AS as_of, entity_id, {f6('med')} AS median_turnover, place::INT AS rank FROM mb"),
        "momentum_rank": ranked(12, 1, "DESC"),
        "momentum_accounted": ranked(12, 1, "DESC", True),
        "reversal_rank": ranked(1, 0, "ASC"),
        "lowvol_rank": staged(low_days + f", mem AS (WITH {core}), lr AS (SELECT entity_id, ln(adjusted / lag(adjusted) OVER (PARTITION BY entity_id ORDER BY date)) AS r FROM a WHERE adjusted > 0 AND entity_id IN (SELECT entity_id FROM mem)), lg AS (SELECT entity_id, stddev_samp(r) * sqrt(252) AS vol FROM lr GROUP BY 1 HAVING count(r) >= 30) SELECT entity_id, {f6('vol')} AS volatility, row_number() OVER (ORDER BY vol, entity_id)::INT AS rank FROM lg", True),
        "trend_stance": staged("% t AS (SELECT date, close::DOUBLE AS close, avg(close::DOUBLE) OVER w AS mean, count(*) OVER w AS k, min(date) OVER w AS since FROM index_levels WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)) SELECT d::VARCHAR AS date, CASE WHEN close IS NULL OR k < 200 OR date - since > 350 THEN 'unknown' WHEN close > mean THEN 'risk on' ELSE 'risk off' END AS stance FROM cal LEFT JOIN t ON t.date = d"),
    }


_CURVE = """curve AS (SELECT run, date, close::DOUBLE * (1 + amp * sin(dayofyear(date) / 10.0::DOUBLE)) * 4 AS equity, CASE WHEN dayofyear(date) % 11 = 0 THEN 0 ELSE 5 END AS held FROM index_levels, (VALUES ('calm', 0.01::DOUBLE), ('wild', 0.2::DOUBLE)) v(run, amp)),
peaks AS (SELECT *, max(equity) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve)"""


def _reports() -> dict[str, str]:
    years = "((t1 - t0) / 365.25::DOUBLE)"
    digest = lambda table, group, key, cols: f"SELECT '{table}' AS \"table\", ({group})::VARCHAR AS part, count(*) AS rows, md5(string_agg(md5(line), '' ORDER BY md5(line))) AS digest FROM (SELECT *, concat_ws('|', {', '.join(cols)}) AS line FROM ({latest(table, key, PIN)})) GROUP BY 2"
    s = lambda c: f"coalesce({c}::VARCHAR, '-')"
    parts = " UNION ALL ".join([
        digest("bars", "date", "source, symbol_id, date", [s(c) for c in ("source", "symbol_id", "series", "open", "high", "low", "close", "volume", "turnover", "delivery_qty")]),
        digest("index_levels", "date", "source, index_code, date", [s(c) for c in ("source", "index_code", "index_name", "close")]),
        digest("symbols", "symbol_id // 1000", "symbol_id", [s(c) for c in ("symbol_id", "isin", "ticker", "valid_from")]),
        digest("symbol_links", "symbol_id // 1000", "symbol_id", [s(c) for c in ("symbol_id", "entity_id", "reason", "boundary", "predecessor")]),
        digest("adjustments", "entity_id // 1000", "entity_id, ex_date", ["entity_id::VARCHAR", "ex_date::VARCHAR", "'eod2-ratio-step'", "ratio::DECIMAL(18,8)::VARCHAR"]),
    ])
    return {
        "tracking_stats": staged(f"% {_CURVE}, w AS (SELECT a.date, a.equity / lag(a.equity) OVER (ORDER BY a.date) - 1 AS x, b.equity / lag(b.equity) OVER (ORDER BY a.date) - 1 AS y FROM curve a JOIN curve b ON a.date = b.date AND a.run = 'calm' AND b.run = 'wild'), q AS (SELECT *, abs(x - y) AS diff FROM w WHERE x IS NOT NULL) SELECT count(*) AS pairs, count(*) FILTER (diff > 0.25) AS dropped, {f6('corr(x, y) FILTER (diff <= 0.25)')} AS correlation, {f6('avg(diff) FILTER (diff <= 0.25)')} AS mean_difference, (SELECT date FROM q WHERE diff <= 0.25 ORDER BY diff DESC, date DESC LIMIT 1)::VARCHAR AS worst_day FROM q"),
        "drawdown": staged(f"% {_CURVE} SELECT run, date::VARCHAR AS date, {f6('peak')} AS peak, {f6('(1 - equity / peak)')} AS drawdown FROM peaks"),
        "growth_report": staged(f"% {_CURVE}, g AS (SELECT run, count(*) AS sessions, min(date) AS t0, max(date) AS t1, arg_max(equity, date) AS final, max(1 - equity / peak) AS dd, count(*) FILTER (held = 0) AS idle, avg(equity) AS mean, CASE run WHEN 'calm' THEN 1000.0::DOUBLE ELSE 2000.0::DOUBLE END AS costs, CASE run WHEN 'calm' THEN 9e5::DOUBLE ELSE 5e6::DOUBLE END AS traded FROM peaks GROUP BY 1), i AS (SELECT arg_min(close::DOUBLE, date) AS b0, arg_max(close::DOUBLE, date) AS b1 FROM index_levels), r AS (SELECT *, pow(final / 1e6::DOUBLE, 1 / {years}) - 1 AS net, pow((final + costs) / 1e6::DOUBLE, 1 / {years}) - 1 AS gross, pow(b1 / b0, 1 / {years}) - 1 AS bench FROM g, i) SELECT run, sessions, {f6('final')} AS final, {f6('net')} AS net_growth, {f6('gross')} AS gross_growth, {f6('bench')} AS benchmark_growth, {f6('(net - bench)')} AS excess, {f6('dd')} AS max_drawdown, idle AS sessions_in_cash, {f6('(costs / 1e6)')} AS cost_share, {f6(f'(traded / mean / {years})')} AS turnover FROM r"),
        "by_year": staged(f"% {_CURVE}, y AS (SELECT run, year(date)::INT AS year, arg_max(equity, date) AS equity FROM curve GROUP BY 1, 2), l AS (SELECT year(date)::INT AS year, arg_max(close::DOUBLE, date) AS lv, min_by(close::DOUBLE, date) AS fv FROM index_levels GROUP BY 1), m AS (SELECT year, lv / coalesce(lag(lv) OVER (ORDER BY year), fv) - 1 AS bench FROM l), x AS (SELECT y.*, equity / coalesce(lag(equity) OVER (PARTITION BY run ORDER BY y.year), 1e6::DOUBLE) - 1 AS ret, bench FROM y LEFT JOIN m USING (year)) SELECT run, year, {f6('equity')} AS equity, {f6('ret')} AS \"return\", {f6('bench')} AS benchmark FROM x"),
        "worst_days": staged(f"% {_CURVE}, c AS (SELECT run, date, equity / lag(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS change FROM curve) SELECT run, row_number() OVER (PARTITION BY run ORDER BY change, date)::INT AS place, date::VARCHAR AS date, {f6('change')} AS change FROM c WHERE change IS NOT NULL QUALIFY place <= 5"),
        "snapshot_parts": staged(parts, True),
        "snapshot_digest": staged(f"% parts AS ({parts}) SELECT \"table\", sum(rows)::BIGINT AS rows, sha256(string_agg(part || '|' || rows::VARCHAR || '|' || digest, ';' ORDER BY part || '|' || rows::VARCHAR || '|' || digest)) AS digest FROM parts GROUP BY 1", True),
    }
