"""Rolling rank correlation and the scored scan, with their oracles."""

from pyspark.sql import functions as F

from tidemark.operators.composites import with_position
from tidemark.operators.rolling import rolling_spearman
from tidemark.plans.q_30_sources_filters import reg
from tidemark.plans.q_55_composites import ASC, CL, ascent
from tidemark.plans.q_60_aggregates import OUT, outcomes

ROLL = OUT + """, ro AS (SELECT model, id, signal, ret, row_number() OVER (PARTITION BY model ORDER BY id) AS i FROM outc WHERE ret IS NOT NULL),
rj AS (SELECT a.model, a.id, b.signal, b.ret FROM ro a JOIN ro b ON a.model = b.model AND b.i BETWEEN a.i - 62 AND a.i WHERE a.i >= 63),
rr AS (SELECT model, id, signal, ret, rank() OVER (PARTITION BY model, id ORDER BY signal) + (count(*) OVER (PARTITION BY model, id, signal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY model, id ORDER BY ret) + (count(*) OVER (PARTITION BY model, id, ret) - 1) / 2.0 AS y FROM rj)"""
reg("rolling_spearman_decay", "model:s id:i ic hit_rate", "signals", "SELECT model, id, corr(x, y) AS ic, avg(CASE WHEN sign(signal) = sign(ret) THEN 1.0 ELSE 0 END) AS hit_rate FROM rr GROUP BY 1, 2", lambda s, d: rolling_spearman(outcomes(s, d).where("ret is not null"), "model", "id", "signal", "ret"), ROLL)


def scan(s, d):
    """Score every instrument, rank the rounded score, keep the board of 25."""
    x = ascent(s, d).select("ticker", (F.floor(F.col("ascent_score") * 10 + 0.5) / 10).alias("score"), "flags")
    return with_position(x, [], "score").where("rank <= 25")


reg("ascent_scan", "ticker score:1 rank:i flags:s", "tails universe", f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS rank FROM (SELECT ticker, round({CL('0.35 * strength + 0.30 * volume + 0.20 * tier_score + 0.15 * high_score')}, 1) AS score, array_to_string(list_filter([
    CASE WHEN mom_12_1 > 0 AND mom_6m > 0 AND mom_3m > 0 AND mom_1m > 0 THEN 'all_horizons' END, CASE WHEN mom_3m * 100 > 30 THEN 'strong_3m' END, CASE WHEN sharpe_3m > 1.5 THEN 'risk_adjusted' END, CASE WHEN volume_surge > 1.4 THEN 'volume' END, CASE WHEN obv_slope > 0.05 THEN 'accumulation' END,
    CASE WHEN tier IN ('small', 'mid') AND strength > 60 THEN 'headroom' END, CASE WHEN dist_from_high < 0.05 THEN 'near_high' END], lambda x: x IS NOT NULL)[1:5], ',') AS flags FROM as3)) WHERE rank <= 25""", scan, ASC)
