"""Queries of the recorder: features of every book state, and the labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import recorder as C
from tidemark.plans.registry import HOUR, query, r6
from tidemark.sources import views as V
from tidemark.sources.views import sql

_RANGE = "PARTITION BY inst ORDER BY ts RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_ROWS = f"""
, t0 AS (SELECT *, bid * 1.0 AS b FROM touches WHERE bid > 0 AND ask > bid),
o0 AS (SELECT *, lag(bid) OVER w AS pb, lag(bid_sz) OVER w AS pbs, lag(ask) OVER w AS pa, lag(ask_sz) OVER w AS pas FROM t0 WINDOW w AS (PARTITION BY inst ORDER BY ts, seq)),
o1 AS (SELECT *, coalesce(CASE WHEN bid > pb THEN bid_sz WHEN bid = pb THEN bid_sz - pbs ELSE -pbs END + CASE WHEN ask < pa THEN -ask_sz WHEN ask = pa THEN pas - ask_sz ELSE pas END, 0) AS ofi FROM o0),
p AS (SELECT inst, ts, max(seq) AS seq, arg_max(bid, seq) AS bid, arg_max(bid_sz, seq) AS bid_sz, arg_max(ask, seq) AS ask, arg_max(ask_sz, seq) AS ask_sz, sum(ofi) AS ofi FROM o1 GROUP BY 1, 2),
m AS (SELECT *, (bid + ask) / 2 AS mid, (bid * ask_sz + ask * bid_sz) / (bid_sz + ask_sz) AS microprice FROM p),
q AS (SELECT *, coalesce(ln(mid / lag(mid) OVER (PARTITION BY inst ORDER BY ts)) ** 2, 0) AS r2 FROM m),
v AS (SELECT *, sum(ofi) OVER ({_RANGE.format(HOUR)}) AS ofi_1s, sum(ofi) OVER ({_RANGE.format(5 * HOUR)}) AS ofi_5s, (ts - min(ts) OVER (PARTITION BY inst)) / {HOUR}.0 AS history,
  count(*) OVER a AS na, (ts - min(ts) OVER a) / {HOUR}.0 AS sa, greatest(0, sum(r2) OVER a - first_value(r2) OVER a) AS xa, count(*) OVER b AS nb, (ts - min(ts) OVER b) / {HOUR}.0 AS sb, greatest(0, sum(r2) OVER b - first_value(r2) OVER b) AS xb
  FROM q WINDOW a AS ({_RANGE.format(10 * HOUR)}), b AS ({_RANGE.format(60 * HOUR)})),
w AS (SELECT *, CASE WHEN na < 3 OR sa <= 0 THEN 0 ELSE sqrt(xa / sa) END AS rv_10s, CASE WHEN nb < 3 OR sb <= 0 THEN 0 ELSE sqrt(xb / sb) END AS rv_60s FROM v),
g AS (SELECT *, list_sort(list(rv_60s) FILTER (rv_60s > 0) OVER (PARTITION BY inst ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS seen FROM w),
tp AS (SELECT inst, ts, sum(CASE WHEN is_buy THEN size ELSE -size END) OVER x / sum(size) OVER x AS tfi_1s, sum(CASE WHEN is_buy THEN size ELSE -size END) OVER y / sum(size) OVER y AS tfi_5s, sum(CASE WHEN is_buy THEN size ELSE -size END) OVER z / sum(size) OVER z AS tfi_30s,
  count(*) OVER x AS n1, sum(size) OVER x AS v1 FROM trades WHERE price > 0 AND size > 0 WINDOW x AS ({_RANGE.format(HOUR)}), y AS ({_RANGE.format(5 * HOUR)}), z AS ({_RANGE.format(30 * HOUR)})),
t1 AS (SELECT DISTINCT * FROM (SELECT inst, ts, first_value(tfi_1s) OVER k AS tfi_1s, first_value(tfi_5s) OVER k AS tfi_5s, first_value(tfi_30s) OVER k AS tfi_30s, first_value(n1) OVER k AS n1, first_value(v1) OVER k AS v1 FROM tp WINDOW k AS (PARTITION BY inst, ts))),
h AS (SELECT g.*, t1.ts AS tape_ts, t1.tfi_1s, t1.tfi_5s, t1.tfi_30s, n1, v1 FROM g ASOF LEFT JOIN t1 ON g.inst = t1.inst AND g.ts >= t1.ts),
i1 AS (SELECT h.*, q.mid AS m1, h.ts - {5 * HOUR} AS at5, h.ts - {30 * HOUR} AS at30 FROM (SELECT *, ts - {HOUR} AS at1 FROM h) h ASOF LEFT JOIN q ON h.inst = q.inst AND h.at1 >= q.ts),
i2 AS (SELECT i1.*, q.mid AS m5 FROM i1 ASOF LEFT JOIN q ON i1.inst = q.inst AND i1.at5 >= q.ts), i3 AS (SELECT i2.*, q.mid AS m30 FROM i2 ASOF LEFT JOIN q ON i2.inst = q.inst AND i2.at30 >= q.ts),
rows AS (SELECT inst, ts, seq, bid, bid_sz, ask, ask_sz, mid, microprice, ask - bid AS spread, (ask - bid) / mid * 1e4 AS spread_bps, (bid_sz - ask_sz) / (bid_sz + ask_sz) AS obi_1, (microprice - mid) / mid * 1e4 AS microprice_delta_bps, ofi_1s, ofi_5s, round(history, 2) AS history_seconds,
  rv_10s, rv_60s, CASE WHEN coalesce(len(seen), 0) < 10 THEN 'unknown' WHEN rv_60s <= seen[floor(len(seen) * 0.33)::INT + 1] THEN 'low_vol' WHEN rv_60s >= seen[floor(len(seen) * 0.67)::INT + 1] THEN 'high_vol' ELSE 'normal_vol' END AS vol_regime,
  coalesce(tfi_1s, 0) AS tfi_1s, coalesce(tfi_5s, 0) AS tfi_5s, coalesce(tfi_30s, 0) AS tfi_30s, coalesce(n1, 0) AS trade_count_1s, coalesce(v1, 0) AS volume_1s, (ts - tape_ts) / {HOUR}.0 AS tape_age_s,
  coalesce(ln(mid / m1) * 1e4, 0) AS ret_1s, coalesce(ln(mid / m5) * 1e4, 0) AS ret_5s, coalesce(ln(mid / m30) * 1e4, 0) AS ret_30s FROM i3)"""
_NUMBERS = ["mid", "microprice", "spread", "spread_bps", "obi_1", "microprice_delta_bps", "ofi_1s", "ofi_5s", "rv_10s", "rv_60s", "tfi_1s", "tfi_5s", "tfi_30s", "volume_1s", "tape_age_s", "ret_1s", "ret_5s", "ret_30s"]
_OUT = "inst, ts, seq, history_seconds, vol_regime, trade_count_1s, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS)
_NAMES = ["inst", "ts", "seq", "history_seconds", "vol_regime", "trade_count_1s", *_NUMBERS]


def _rows(s, d):
    return C.feature_rows(V.touches(s, d), V.trades(s, d), "inst", second_ms=HOUR, regime_rows=30, regime_least=10)


@query("feature_rows", sql(f"{_ROWS} SELECT {_OUT} FROM rows", "touches", "trades"))
def feature_rows(s, d):
    return r6(_rows(s, d).select(*_NAMES))


@query("recorded_rows", sql(f"""{_ROWS},
nx AS (SELECT a.inst, a.ts, min(b.ts) AS nxt FROM rows a LEFT JOIN rows b ON b.inst = a.inst AND b.ts >= a.ts + {4 * HOUR} GROUP BY 1, 2),
k AS (SELECT inst, min(ts) AS ts FROM rows GROUP BY 1 UNION ALL SELECT nx.inst, nxt FROM k JOIN nx USING (inst, ts) WHERE nxt IS NOT NULL),
e AS (SELECT inst, max(ts) AS last FROM rows GROUP BY 1),
f AS (SELECT rows.*, rows.ts + {6 * HOUR} AS at6, rows.ts + {24 * HOUR} AS at24 FROM rows JOIN k USING (inst, ts) JOIN e USING (inst) WHERE last - rows.ts >= {24 * HOUR}),
x AS (SELECT f.*, q.mid AS m6 FROM f ASOF JOIN q ON f.inst = q.inst AND f.at6 <= q.ts), y AS (SELECT x.*, q.mid AS m24 FROM x ASOF JOIN q ON x.inst = q.inst AND x.at24 <= q.ts)
SELECT inst, ts, round(mid, 6) AS mid, round((m6 / mid - 1) * 1e4 + 1e-9, 4) AS fwd_ret_bps_6s, CASE WHEN (m6 / mid - 1) * 1e4 >= 500 THEN 1 WHEN (m6 / mid - 1) * 1e4 <= -500 THEN -1 ELSE 0 END AS label_6s,
  round((m24 / mid - 1) * 1e4 + 1e-9, 4) AS fwd_ret_bps_24s, CASE WHEN (m24 / mid - 1) * 1e4 >= 500 THEN 1 WHEN (m24 / mid - 1) * 1e4 <= -500 THEN -1 ELSE 0 END AS label_24s FROM y""", "touches", "trades").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def recorded_rows(s, d):
    r = C.recorded(_rows(s, d), C.book_states(V.touches(s, d), "inst"), "inst", 4 * HOUR, {"6s": 6 * HOUR, "24s": 24 * HOUR}, 500.0)
    return r.select("inst", "ts", V.rounded(F.col("mid")).alias("mid"), "fwd_ret_bps_6s", "label_6s", "fwd_ret_bps_24s", "label_24s")
