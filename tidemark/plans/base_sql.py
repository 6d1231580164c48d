"""Shared CTEs of the DuckDB oracles; they restate the adaptors in plain SQL."""

from __future__ import annotations

TD = "(CAST({d} AS DATE) + CASE isodow({d}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"


def trading_day(d: str) -> str:
    return TD.format(d=d)


SYMBOL = {"flag": "l_returnflag||l_linestatus", "supplier": "'S'||CAST(l_suppkey AS VARCHAR)"}


def bars(by: str = "flag", name: str = "bars") -> str:
    p = name
    return f"""
{p}_d AS (
  SELECT {SYMBOL[by]} AS symbol, {trading_day('l_shipdate')} AS ts,
    CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT)/100.0/sum(l_quantity) AS pc,
    (min(l_extendedprice/l_quantity)+max(l_extendedprice/l_quantity))/2 AS po, count(*) AS n,
    sum(l_quantity) AS qty,
    CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS d, CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS t
  FROM lineitem GROUP BY 1,2),
{p}_m AS (SELECT *, round(avg(pc) OVER (PARTITION BY symbol),6) mu, round(avg(po) OVER (PARTITION BY symbol),6) muo, round(stddev_samp(pc) OVER (PARTITION BY symbol),6) sd, round(stddev_samp(po) OVER (PARTITION BY symbol),6) sdo FROM {p}_d),
{p}_g AS (SELECT *, coalesce(round(0.004::DOUBLE*(po-muo)/nullif(sdo,0),8),0) g, coalesce(round(0.006::DOUBLE*(pc-mu)/nullif(sd,0),8),0) i FROM {p}_m),
{p}_c AS (SELECT *, round(100.0::DOUBLE*exp(CAST(sum(CAST(round(ln((1+g)*(1+i)),10) AS DECIMAL(18,10))) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE)),6) AS close FROM {p}_g),
{p} AS MATERIALIZED (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, round(close/(1+i),6) AS open, close,
  round(close*(1-0.001::DOUBLE*(d/(100.0::DOUBLE*n))),6) AS adj_close, n, qty, d/(100.0::DOUBLE*n) AS disc, t/(100.0::DOUBLE*n) AS tax FROM {p}_c)"""


OBS = """
obs AS MATERIALIZED (SELECT 'P'||substr(o_orderpriority,1,1) AS series_id, CAST(o_orderdate AS DATE) AS ts,
  CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT)/(count(*)*1e7::DOUBLE) AS value FROM orders GROUP BY 1,2)"""

CAL = """
cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM bars))"""

SID = "CASE substr(symbol,1,1) WHEN 'A' THEN 'P1' WHEN 'R' THEN 'P2' ELSE 'P3' END"


def z(expr: str, k: int, part: str = "symbol") -> str:
    """Guarded rolling z-score over k rows, rounded to 6 digits."""
    w = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"round(CASE WHEN count({expr}) {w}={k} THEN (({expr})-avg({expr}) {w})/nullif(stddev_samp({expr}) {w},0) END,6)"
    )


def mean(expr: str, k: int, part: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) {w}={k} THEN avg({expr}) {w} END"


def std(expr: str, k: int, part: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) {w}={k} THEN stddev_samp({expr}) {w} END"


_LEVELS = ",".join(
    f"round(CAST(sum(CASE WHEN p={j+1} THEN c END) AS DOUBLE)/count(CASE WHEN p={j+1} THEN 1 END)/1.25e7::DOUBLE,4) AS pce{j},"
    f"round(CAST(sum(CASE WHEN p={j+1} THEN f END) AS DOUBLE)/count(CASE WHEN p={j+1} THEN 1 END)/0.1::DOUBLE,4) AS rate{j}"
    for j in range(4)
)

PROJ = f"""
proj_o AS (SELECT date_trunc('quarter', CAST(o_orderdate AS DATE))::DATE q, CAST(substr(o_orderpriority,1,1) AS INT) p,
  CAST(round(o_totalprice*100) AS BIGINT) c, CAST(o_orderstatus='F' AS BIGINT) f FROM orders),
proj AS (SELECT *, year(md) AS y, CAST(year(md)+CASE WHEN month(md)>=9 THEN 1 ELSE 0 END AS INT) AS ty FROM (
  SELECT CAST(q + INTERVAL 2 MONTH AS DATE)+14 AS md, {_LEVELS} FROM proj_o GROUP BY q)),
prev AS (SELECT *, lag(y) OVER (ORDER BY md) py, {','.join(f'lag({v}{j}) OVER (ORDER BY md) p{v}{j}' for v in ('pce','rate') for j in range(4))},
  lag(ty) OVER (ORDER BY md) pty FROM proj),
sigrow AS (SELECT md, ty, pty=ty AS same_ty, row_number() OVER (ORDER BY md) rn,
  CASE ty-y WHEN 0 THEN pce0 WHEN 1 THEN pce1 END AS pce, CASE ty-y WHEN 0 THEN rate0 WHEN 1 THEN rate1 END AS rate,
  CASE ty-py WHEN 0 THEN ppce0 WHEN 1 THEN ppce1 WHEN 2 THEN ppce2 END AS prev_pce,
  CASE ty-py WHEN 0 THEN prate0 WHEN 1 THEN prate1 WHEN 2 THEN prate2 END AS prev_rate FROM prev),
pcond AS (SELECT *, CASE WHEN rate>prev_rate AND pce>2 AND pce>prev_pce THEN 0 WHEN rate<=prev_rate AND pce IS NOT NULL AND prev_pce IS NOT NULL THEN 1 END AS ev
  FROM sigrow WHERE rn>1 AND pce IS NOT NULL),
lat AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (ORDER BY md),1) AS st FROM pcond),
psig AS (SELECT *, CASE WHEN st<>coalesce(lag(st) OVER (ORDER BY md),1) THEN CASE st WHEN 1 THEN 'ENTER' ELSE 'EXIT' END ELSE '' END AS signal FROM lat)"""

MASTER = """
mapped AS (SELECT (SELECT min(ts) FROM cal WHERE ts>=md) AS ts, md, signal FROM psig WHERE signal<>''),
mday AS (SELECT ts, arg_max(signal, md) AS signal FROM mapped WHERE ts IS NOT NULL GROUP BY ts),
mstate AS MATERIALIZED (SELECT cal.ts, cal.pos, coalesce(last_value(CASE signal WHEN 'ENTER' THEN 1 WHEN 'EXIT' THEN 0 END IGNORE NULLS) OVER (ORDER BY cal.ts),1) AS master
  FROM cal LEFT JOIN mday USING (ts))"""

# per-symbol signal frame: returns, rate, four z-scores and the master state
SIG = f"""
s0 AS (SELECT b.symbol, b.ts, b.pos, b.close, b.close/lag(b.close) OVER w-1 AS r, b.open/lag(b.close) OVER w-1 AS gap, b.close/b.open-1 AS intra,
    (1+disc)/(1+tax) AS cr, (1+tax)/(1+qty/(100.0::DOUBLE*n)) AS inf, 1000+qty-n-disc AS nl, {SID} AS series_id
  FROM bars b WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts)),
s1 AS (SELECT *, {std('r', 20)} * sqrt(252) AS vol, nl/lag(nl,63) OVER (PARTITION BY symbol ORDER BY ts)-1 AS nlc FROM s0),
s2 AS (SELECT symbol, ts, pos, close, r, gap, intra, series_id, -{z('cr', 252)} AS z, {z('vol', 252)} AS vz, {z('inf', 63)} AS iz, {z('nlc', 252)} AS nlz FROM s1),
sig AS MATERIALIZED (SELECT s2.*, coalesce(o.value,0)/100/252 AS rate, m.master FROM s2 ASOF LEFT JOIN obs o ON s2.series_id=o.series_id AND s2.ts>=o.ts
  JOIN mstate m ON m.ts=s2.ts)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def signal_frame(by: str = "flag") -> list[str]:
    return [bars(by), OBS, CAL, PROJ, MASTER, SIG]
