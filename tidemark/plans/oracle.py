"""The derived tables of tidemark.sources.views as SQL, and a helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[str, str]] = {
    "bars": ("", """
daily AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, round(sum(l_extendedprice), 2) AS ext,
    sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
daily_u AS (SELECT *, ext / v AS u FROM daily),
daily_r AS (SELECT *, round(greatest(least(0.02 * (u / avg(u) OVER (PARTITION BY ticker) - 1), 0.1), -0.1), 8) AS r0 FROM daily_u),
daily_c AS (SELECT *, round(100 * exp(sum(r0) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)), 4) AS c FROM daily_r),
daily_o AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY ticker ORDER BY d), c) AS o FROM daily_c),
bars AS (SELECT ticker, d, o, round(greatest(o, c) * (1 + 0.01 * (n % 3)), 4) AS h,
    round(least(o, c) * (1 - 0.01 * (n % 2)), 4) AS l, c, v, n, u FROM daily_o)"""),
    "rets": ("bars", """
rets AS (SELECT *, row_number() OVER w AS rn, c / lag(c) OVER w - 1 AS r, ln(c / lag(c) OVER w) AS lr
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d))"""),
    "tails": ("rets", "tails AS (SELECT *, count(*) OVER (PARTITION BY ticker) - rn AS k FROM rets)"),
    "fret": ("rets", """
fret AS (SELECT d, n_regionkey AS f, round(avg(r), 8) AS fr FROM rets JOIN supplier ON ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE r IS NOT NULL GROUP BY 1, 2)"""),
    "bench": ("rets", """
bench_m AS (SELECT d, coalesce(round(avg(r), 8), 0.0) AS m FROM rets GROUP BY d),
bench AS (SELECT d, round(100 * exp(sum(ln(1 + m)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)), 4) AS c FROM bench_m)"""),
    "mkt": ("bench", "mkt AS (SELECT d, c, c / lag(c) OVER (ORDER BY d) - 1 AS mr FROM bench)"),
    "universe": ("bars", """
last_px AS (SELECT ticker, arg_max(c, d) AS last_c, sum(v) AS sum_v FROM bars GROUP BY 1),
universe AS (SELECT ticker, s_name AS name, lpad(CAST(n_regionkey AS VARCHAR), 1, '0') || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
    || CAST(s_suppkey % 3 AS VARCHAR) AS sic_code, r_name AS bucket, round(last_c * sum_v, 2) AS market_cap, s_acctbal > 0 AS active
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN last_px ON s_suppkey = ticker)"""),
    "quarters": ("", """
q0 AS (SELECT l_suppkey AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_quantity * p_retailprice), 2) AS cost_of_revenue,
    round(sum(l_extendedprice * l_tax), 2) AS tax, sum(l_quantity) AS qty, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
q1 AS (SELECT *, round(revenue - cost_of_revenue, 2) AS gross_profit FROM q0),
q2 AS (SELECT *, round(gross_profit - tax - 0.45 * revenue, 2) AS net_income FROM q1),
q3 AS (SELECT *, round(net_income * (1 + 0.1 * (n % 3 - 1)), 2) AS op_cash_flow,
    round(sum(revenue) OVER (w ROWS 7 PRECEDING), 2) AS assets, round(sum(cost_of_revenue) OVER (w ROWS 3 PRECEDING), 2) AS liabilities,
    sum(qty) OVER (w ROWS 3 PRECEDING) AS shares, round(sum(net_income) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS retained_earnings,
    row_number() OVER w AS q FROM q2 WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),
quarters AS (SELECT *, round(assets - liabilities, 2) AS equity, round(assets * (0.35 + 0.05 * (n % 4)), 2) AS current_assets,
    round(liabilities * (0.4 + 0.05 * (n % 3)), 2) AS current_liabilities, round(assets * 0.08, 2) AS cash,
    round(liabilities * 0.3, 2) AS debt, round(revenue * 0.04 * (1 + n % 2), 2) AS capex,
    round(revenue * 0.15 * (1 + 0.1 * (n % 5)), 2) AS receivables, round(cost_of_revenue * 0.1, 2) AS inventory,
    round(assets * 0.3, 2) AS ppe, round(revenue * 0.05, 2) AS rd, round(revenue * 0.1, 2) AS sga,
    round(assets * 0.005, 2) AS depreciation, round(round(liabilities * 0.3, 2) * 0.01, 2) AS interest,
    CASE WHEN n % 4 = 0 THEN round(revenue * 0.01, 2) ELSE 0.0 END AS dividends,
    CASE WHEN n % 5 = 0 THEN round(revenue * 0.02, 2) ELSE 0.0 END AS buybacks,
    round(gross_profit - round(revenue * 0.05, 2) - round(revenue * 0.1, 2), 2) AS operating_income,
    period_end + CAST(20 + ticker % 45 AS INTEGER) AS filed FROM q3)"""),
    "facts": ("quarters", """
flong AS (SELECT cik, period_end, filed, q, metric, val FROM (SELECT ticker AS cik, * FROM quarters)
    UNPIVOT (val FOR metric IN (revenue, cost_of_revenue, gross_profit, net_income, op_cash_flow, assets, liabilities, shares))),
fq AS (SELECT cik, metric, CAST(date_trunc('quarter', period_end) AS DATE) AS start, period_end AS "end", filed, val,
    'Q' || quarter(period_end) AS fp, '10-Q' AS form, q FROM flong WHERE NOT (quarter(period_end) = 4 AND cik % 4 = 0)),
fr AS (SELECT * REPLACE (round(val * 1.01, 2) AS val, filed + 200 AS filed) FROM fq WHERE (cik + q) % 7 = 0),
fy0 AS (SELECT cik, metric, year(period_end) AS fy, max(period_end) AS "end", max(filed) AS filed, sum(val) AS s,
    arg_max(val, period_end) AS last_val, metric IN ('revenue', 'cost_of_revenue', 'gross_profit', 'net_income', 'op_cash_flow') AS flow
    FROM flong GROUP BY 1, 2, 3 HAVING count(*) = 4),
facts AS (SELECT * EXCLUDE (q) FROM fq UNION ALL SELECT * EXCLUDE (q) FROM fr UNION ALL
    SELECT cik, metric, CASE WHEN flow THEN make_date(CAST(fy AS INTEGER), 1, 1) ELSE "end" END, "end", filed,
    round(CASE WHEN flow THEN s ELSE last_val END, 2), 'FY', '10-K' FROM fy0)"""),
    "holdings": ("", """
holdings AS (SELECT last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter, l_partkey AS cusip,
    o_custkey AS manager, CASE WHEN l_returnflag = 'R' THEN 'PUT' ELSE '' END AS putcall, sum(l_quantity) AS shares,
    round(sum(l_extendedprice), 2) AS value_usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"""),
    "insider": ("", """
insider AS (SELECT l_suppkey AS issuer, CAST(l_shipdate AS DATE) AS filed, o_custkey AS owner,
    CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'S' END AS code, l_quantity AS shares, l_extendedprice / l_quantity AS price,
    l_extendedprice AS value, o_custkey % 4 = 0 AS is_officer, o_custkey % 7 = 0 AS is_director, l_orderkey AS accession
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""),
    "edges": ("", """
eb AS (SELECT l_suppkey AS src, c_mktsegment, n_name, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
eg AS (SELECT src, c_mktsegment AS dst, 1 AS tier, round(sum(l_extendedprice), 2) AS rev FROM eb GROUP BY 1, 2
    UNION ALL SELECT src, n_name, 2, round(sum(l_extendedprice), 2) FROM eb GROUP BY 1, 2),
edges AS (SELECT src, dst, tier, round(rev / sum(rev) OVER (PARTITION BY src, tier), 8) AS weight,
    (src + length(dst)) % 5 <> 0 AS confirmed FROM eg)"""),
    "signals": ("", """
signals AS (SELECT user_id AS ticker, ts AS generated_at, event_type AS model, value - 50 AS signal, event_id AS id FROM events)"""),
    "ticks": ("", """
ticks AS (SELECT user_id AS ticker, ts, 100 + value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
    event_id AS id FROM events)"""),
    "articles": ("", """
articles AS (SELECT documents.doc_id, documents.doc_id % (SELECT count(*) FROM supplier) AS ticker,
    DATE '2024-01-01' + CAST((documents.doc_id * 7) % 30 AS INTEGER) AS published, source AS publisher, split_part(text, chr(10), 1) AS title,
    text AS body, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
    FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"""),
    "chain": ("", """
chain AS (SELECT p_brand AS underlying, round(p_retailprice / 10) * 10 AS strike, p_size * 7 AS days_to_expiry,
    0.15 + 0.01 * (p_size % 20) AS iv, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS oi_call,
    sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END) AS oi_put,
    sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS vol_call,
    sum(CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS vol_put
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, 2, 3, 4)"""),
    "membership": ("", """
mem0 AS (SELECT l_suppkey AS ticker, CAST(min(l_shipdate) AS DATE) AS ipo, CAST(max(l_shipdate) AS DATE) AS last_d FROM lineitem GROUP BY 1),
membership AS (SELECT ticker, ipo, CASE WHEN ticker % 9 = 0 THEN last_d END AS delist, CASE WHEN ticker % 9 = 0 THEN
    ['bankruptcy', 'performance', 'acquisition', 'merger', 'voluntary', 'exchange_transfer'][CAST(floor(ticker / 9) AS BIGINT) % 6 + 1] END AS reason FROM mem0)"""),
}


def half_up(sql: str) -> str:
    """round(x, k) -> floor(x * 10^k + 0.5) / 10^k, so that ties on stored decimals break the same way everywhere."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        arg, places = (sql[j + 6:comma], sql[comma + 1:k - 1].strip()) if comma >= 0 else (sql[j + 6:k - 1], "0")
        out += sql[i:j] + f"(floor(({half_up(arg)}) * 1e{places} + 0.5) / 1e{places})"
        i = k
    return out + sql[i:]


def doubles(sql: str) -> str:
    """Decimal literals as doubles: 0.05 is an exact DECIMAL in SQL but a binary double in Spark's Python API."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def ewm(x: str, alpha: float | str, first: int = 1, rn: str = "rn", over: str = "w") -> str:
    """Recursive exponential average as one running sum (short histories only)."""
    k = f"({rn} - {first})"
    return (f"(CASE WHEN {k} >= 0 THEN pow(1.0 - {alpha}, {k}) * sum(CASE WHEN {k} = 0 THEN ({x}) WHEN {k} > 0 THEN "
            f"{alpha} * ({x}) * pow(1.0 - {alpha}, -{k}) END) OVER ({over} ROWS UNBOUNDED PRECEDING) END)")


def full(agg: str, n: int, x: str | None = None, over: str = "w") -> str:
    """agg over the last n rows, null until n non-null values are there; agg may use {} for extra arguments."""
    x = x or agg[agg.index("(") + 1:agg.rindex(")")]
    return f"(CASE WHEN count({x}) OVER ({over} ROWS {n - 1} PRECEDING) = {n} THEN {agg} OVER ({over} ROWS {n - 1} PRECEDING) END)"


W = "WINDOW w AS (PARTITION BY ticker ORDER BY d)"


def with_views(views: str, body: str, ctes: str = "") -> str:
    """WITH <views and their inputs>, <ctes> <body>."""
    order: list[str] = []

    def add(v):
        if v in order:
            return
        for dep in VIEWS[v][0].split():
            add(dep)
        order.append(v)

    for v in views.split():
        add(v)
    parts = [VIEWS[v][1].strip() for v in order] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    return half_up(doubles(f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()))


def sql_horner(coef, x: str) -> str:
    acc = ""
    for c in coef:
        acc = f"{c!r}" if not acc else f"({acc} * {x} + {c!r})"
    return acc


def sql_norm_cdf(x: str) -> str:
    from tidemark.functions.normal import CDF_DEN, CDF_NUM

    a = f"abs({x})"
    tail = f"(CASE WHEN {a} > 7.07 THEN 0.0 ELSE exp(-{a} * {a} / 2) * {sql_horner(CDF_NUM, a)} / {sql_horner(CDF_DEN, a)} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_norm_ppf(p: str) -> str:
    from tidemark.functions.normal import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {PPF_LOW} THEN {sql_horner(PPF_C, lo)} / {sql_horner(PPF_D, lo)} "
            f"WHEN {p} <= {1 - PPF_LOW!r} THEN {sql_horner(PPF_A, r)} * {q} / {sql_horner(PPF_B, r)} ELSE -{sql_horner(PPF_C, hi)} / {sql_horner(PPF_D, hi)} END)")
