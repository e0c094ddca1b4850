"""Text rules as column expressions: keyword presence and counts, materiality, event class, facts and names.

Word lists are arguments; the defaults below are the fixed lists of the news rules. Whole texts are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, weights and patterns of the news rules, in their order of precedence.
PASSING = ("mentioned as", "mentioned only", "listed as", "included in the broader", "not the focus", "without additional commentary", "no substantive analysis", "brief mention", "only in a headline reference",
           "not specifically analyzed", "part of the dominant", "classified as")
MATERIAL = {"earnings": 9, "quarterly results": 9, "guidance": 9, "revenue": 7, "margin": 7, "profit": 7, "outlook": 7, "forecast": 6, "beat": 6, "miss": 6, "downgrade": 8, "upgrade": 8, "price target": 7, "acquisition": 8, "merger": 8,
            "buyback": 6, "dividend": 6, "lawsuit": 6, "investigation": 7, "recall": 7, "antitrust": 7, "regulator": 6, "sec filing": 6, "ceo": 6, "cfo": 6, "steps down": 7, "layoff": 6, "launch": 5, "unveil": 5, "supply": 5,
            "shortage": 6, "tariff": 6, "ban": 6}
FLUFF = ("best stocks", "should you buy", "stocks to buy", "etf", "mutual fund", "index fund", "10 stocks", "top 5", "millionaire", "retire", "dividend kings", "motley fool picks", "market size worth", "cagr", "forecast to 2030",
         "forecast to 2035")
WIRES = ("globenewswire", "prnewswire", "businesswire", "accesswire")
SOURCE_WEIGHTS = {"reuters": 95, "bloomberg": 95, "wall street journal": 92, "wsj": 92, "financial times": 92, "cnbc": 85, "barron": 85, "marketwatch": 80, "associated press": 90, "ap news": 90, "investor's business daily": 80,
                  "seeking alpha": 60, "benzinga": 65, "investing.com": 65, "the motley fool": 55, "zacks": 60, "simply wall st": 50, "insider monkey": 45, "globenewswire": 70, "prnewswire": 70, "businesswire": 70, "accesswire": 55}
HEDGES = ("could", "would", "might", "may ", "expects", "projected", "forecast", "if ", "should", "potential", "possible", "likely to", "aims to", "plans to", "hopes")


def keyword_hits(text: Column, keywords) -> Column:
    """Number of distinct keywords inside the text. Spelled out as a sum so that the lowered text is one shared
    subexpression of the generated code."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def has_any(text: Column, keywords) -> Column:
    return keyword_hits(text, keywords) > 0


def _any_lowered(low: Column, keywords) -> Column:
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0)) > 0


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of one keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.length(low) - F.length(F.replace(low, F.lit(keyword), F.lit("")))) / len(keyword)


def keyword_sentiment(text: Column, bull, bear) -> dict[str, Column]:
    b, r = keyword_hits(text, bull), keyword_hits(text, bear)
    tot = F.greatest(b + r, F.lit(1))
    pos, neg = F.least(b / tot * 0.8, F.lit(0.9)), F.least(r / tot * 0.8, F.lit(0.9))
    return {"positive": pos, "negative": neg, "neutral": F.greatest(1 - pos - neg, F.lit(0.1)), "score": pos - neg}


def materiality(title: Column, reason: Column, publisher: Column, material=None, passing=PASSING, fluff=FLUFF, wires=WIRES) -> Column:
    """40, less 30 in passing, plus at most 45 from the first four material words, less 25 for lists, less 12 for wires. The texts are
    lowered once, as the element of an array: inside array functions a shared subexpression would be computed for every word."""
    material = MATERIAL if material is None else material

    def rated(x: Column) -> Column:
        t, r = x["t"], x["r"]
        found = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)) | F.contains(r, F.lit(k)), v) for k, v in material.items()]))
        gain = F.least(F.aggregate(F.slice(found, 1, 4), F.lit(0), lambda a, v: a + v), F.lit(45))
        s = F.lit(40) - F.when(_any_lowered(r, passing), 30).otherwise(0) + gain - F.when(_any_lowered(t, fluff), 25).otherwise(0) - F.when(_any_lowered(x["p"], wires), 12).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), s))

    low = F.struct(*[F.lower(F.coalesce(v, F.lit(""))).alias(k) for k, v in (("t", title), ("r", reason), ("p", publisher))])
    return F.element_at(F.transform(F.array(low), rated), 1)


def source_weight(publisher: Column, table=None, default: int = 60) -> Column:
    """Weight of the first listed name inside the publisher."""
    low = F.lower(F.coalesce(publisher, F.lit("")))
    table = SOURCE_WEIGHTS if table is None else table
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in table.items()], F.lit(default))


def classify(title: Column, reason: Column, reported, speculative, analyst, kinds: list[tuple[str, tuple]]) -> dict[str, Column]:
    """EVENT, ANALYST or COMMENTARY with the event kind. Speculation counts words of the title, a question mark, a
    leading question and a future or dated framing (twice)."""
    t = F.lower(F.coalesce(title, F.lit("")))
    blob = F.concat_ws(" ", t, F.lower(F.coalesce(reason, F.lit(""))))
    figure = F.rlike(blob, F.lit(r"\$\s?[\d,.]+|\d+(\.\d+)?\s?%|\bq[1-4]\b"))
    rep, spec = keyword_hits(blob, reported), keyword_hits(t, speculative)
    ask = F.rlike(t, F.lit(r"\?\s*$|^\s*\w+:\s*(can|will|is|should|does|why)\b|\b(can|will|would|might|may)\b[^.]{0,60}\b(justify|beat|reach|hit|survive|continue|last)\b"))
    fut = F.rlike(t, F.lit(r"\b(will|would|could|should|expects? to|set to|poised to|on track to)\b|^\s*(prediction|forecast|outlook:|preview)|\bin (20\d\d|\w+ 20\d\d)\b"))
    spec = spec + ask.cast("int") + 2 * fut.cast("int")
    kind = F.coalesce(*[F.when(has_any(blob, ws), k) for k, ws in kinds], F.lit(None))
    said = F.rlike(t, F.lit(r"\b(announce[sd]?|unveil[sed]*|report[sed]*|post[sed]*|sign[sed]*|complete[sd]*|acquire[sd]*)\b"))
    act = F.rlike(t, F.lit(r"(price target|upgrade[sd]?|downgrade[sd]?|initiat|reiterat|raises|lowers|cuts)"))
    cls = (F.when(said & kind.isNotNull() & (spec == 0), "EVENT").when(has_any(blob, analyst) & (spec == 0) & act, "ANALYST").when((spec >= 1) & (rep == 0), "COMMENTARY")
           .when((rep >= 1) & kind.isNotNull() & (spec == 0) & (figure | (rep >= 2)), "EVENT").otherwise("COMMENTARY"))
    return {"class": cls, "event_kind": F.when(cls == "EVENT", kind), "has_figure": figure}


def latin_ratio(title: Column) -> Column:
    """Share of characters below U+0250 (one for an empty title)."""
    n = F.length(title)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(F.length(F.regexp_replace(title, "[^\\x{0000}-\\x{024F}\\s]", "")) / n)


def sentences(text: Column) -> Column:
    """Sentence pieces of 25 to 200 characters without the leading connective."""
    parts = F.split(text, r"(?<=[.;])\s+|\s+\(\d\)\s*")
    lead = r"(?i)^(however|while|although|but|and|also|meanwhile|additionally|further(?:more)?|though)[,\s]+"
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*\(\d+\)\s*", ""), lead, ""), F.lit(" .,;")))
    return F.filter(clean, lambda p: F.length(p).between(25, 200))


def business_section(text: Column, longest: int = 400_000) -> Column:
    """Longest stretch between an `Item 1 ... business` heading and the next `Item 2 ... properties`; the whole text
    without one."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "&#?\\w+;", " "), "\\s+", " ")
    parts = F.slice(F.split(t, r"(?i)item\s*1\b.{0,60}?business"), 2, 1_000_000)
    bodies = F.transform(parts, lambda p: F.element_at(F.split(p, r"(?i)item\s*2\b.{0,60}?propert"), 1))
    best = F.array_max(F.transform(bodies, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return F.when(best["n"] > 5000, best["p"]).otherwise(t)
