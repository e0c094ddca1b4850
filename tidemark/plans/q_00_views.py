"""The derived tables themselves, so that the adapters are checked on their own."""

from tidemark.plans.oracle import with_views
from tidemark.plans.registry import query
from tidemark.sources import views as V

query("view_bars", "ticker d o:4 h:4 l:4 c:4 v:2 n:i", with_views("bars", "SELECT * FROM bars"))(V.bars)
query("view_bench", "d c:4", with_views("bench", "SELECT * FROM bench"))(lambda s, d: V.bench(V.bars(s, d)))
query("view_universe", "ticker name:s sic_code:s bucket:s market_cap:2 active:i",
      with_views("universe", "SELECT * FROM universe"))(V.universe)
query("view_quarters", "ticker period_end:s filed:s revenue:2 net_income:2 op_cash_flow:2 assets:2 liabilities:2 shares:2 "
      "equity:2 retained_earnings:2 current_assets:2 current_liabilities:2 capex:2 receivables:2 operating_income:2",
      with_views("quarters", "SELECT * FROM quarters"))(V.quarters)
query("view_facts", "cik:i metric:s start:s end:s filed:s val:2 fp:s form:s",
      with_views("facts", "SELECT * FROM facts"))(V.facts)
query("view_holdings", "quarter:s cusip:i manager:i putcall:s shares:2 value_usd:2", with_views("holdings", "SELECT * FROM holdings"))(V.holdings)
query("view_edges", "src:i dst:s tier:i weight:6 confirmed:i", with_views("edges", "SELECT * FROM edges"))(V.edges)
query("view_articles", "doc_id:i ticker published:s publisher:s title:s sentiment:s",
      with_views("articles", "SELECT * FROM articles"))(V.articles)
query("view_chain", "underlying:s strike:2 days_to_expiry:i iv:6 oi_call:2 oi_put:2 vol_call:2 vol_put:2",
      with_views("chain", "SELECT * FROM chain"))(V.chain)
query("view_membership", "ticker ipo:s delist:s reason:s", with_views("membership", "SELECT * FROM membership"))(V.membership)
query("view_ticks", "ticker ts:s price:4 size:4 id:i", with_views("ticks", "SELECT * FROM ticks"))(V.ticks)
