"""News aggregates: sentiment windows, top lists, story de-duplication, facts, names and relationships."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.frames import clip, dealt
from tidemark.functions.overlaps import overlapping

c = F.col
BLOCK_WORDS, TITLE_WORDS = 1_000_000, 16  # words of a block of titles; what a title counts besides its words


def sentiment_value(s: Column) -> Column:
    return F.when(s == "positive", 1).when(s == "negative", -1).otherwise(0)


def news_features(a: DataFrame, now: str, key: str = "ticker") -> DataFrame:
    """Weighted sentiment, windows, velocity, publisher counts per instrument. Publisher counts are pre-aggregated, so an
    instrument with a third of all articles is summed map-side. a: key, published, publisher, sentiment, in_title."""
    t = F.lit(now).cast("date")
    v, w, age = sentiment_value(c("sentiment")), F.when(c("in_title"), 1.0).otherwise(0.5), F.datediff(t, c("published"))
    x = a.select(key, "publisher", v.alias("v"), w.alias("w"), age.alias("age"))
    in7, prior = c("age") <= 7, (c("age") > 7) & (c("age") <= 30)
    g = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("W"), F.sum(c("w") * c("v")).alias("wv"), F.sum(F.when(c("v") > 0, c("w")).otherwise(0.0)).alias("wp"), F.sum(F.when(c("v") < 0, c("w")).otherwise(0.0)).alias("wn"),
                           F.sum("v").alias("sv"), F.sum(c("v") * c("v")).alias("svv"), F.avg(F.when(in7, c("v"))).alias("s7"), F.avg(F.when(c("age") <= 30, c("v"))).alias("s30"), F.avg(F.when(prior, c("v"))).alias("sp"),
                           F.sum(in7.cast("int")).alias("n7"), F.sum((c("age") <= 30).cast("int")).alias("n30"))
    p = x.groupBy(key, "publisher").agg(F.count(F.lit(1)).alias("k")).groupBy(key).agg(F.count(F.lit(1)).alias("publishers"), F.max("k").alias("top"))
    m = c("wv") / c("W")
    base = c("n30") / 30
    return g.join(p, key).select(key, "n", ((c("wp") - c("wn")) / c("W")).alias("net_sentiment"), (c("wp") / c("W")).alias("positive_ratio"), m.alias("sentiment_mean"), F.sqrt((c("svv") - 2 * m * c("sv") + c("n") * m * m) / c("n")).alias("dispersion"),
                                 c("s7").alias("sentiment_7d"), c("s30").alias("sentiment_30d"), F.coalesce(c("s7") - c("sp"), c("s7") - c("s30"), F.lit(0.0)).alias("sentiment_trend"), (c("n7") / 7).alias("velocity"),
                                 F.when(base > 0, c("n7") / 7 / base).alias("volume_vs_baseline"), F.when((base > 0) & (c("n7") / 7 > 2 * base), 1).otherwise(0).alias("volume_spike"), "publishers", (c("top") / c("n")).alias("source_concentration"))


def social_sentiment(posts: DataFrame, key: str) -> DataFrame:
    """Quality-weighted mean of post scores (under five words skipped); the contrarian form flips a strong mean.
    posts: key, text, score, up, comments."""
    x = posts.where(F.size(F.split(F.trim("text"), "\\s+")) >= 5).withColumn("w", F.log1p(F.greatest("up", F.lit(1))) * F.sqrt(1 + F.greatest("comments", F.lit(0))))
    g = x.groupBy(key).agg((F.sum(c("score") * c("w")) / F.sum("w")).alias("social_score"), F.count(F.lit(1)).alias("n_posts"), F.stddev_pop("score").alias("dispersion"), F.avg((F.abs("score") > 0.3).cast("double")).alias("high_conviction"))
    return g.withColumn("contrarian", F.when(F.abs("social_score") > 0.3, -c("social_score")).otherwise(c("social_score"))).withColumn("label", F.when(c("social_score") > 0.1, "BULLISH").when(c("social_score") < -0.1, "BEARISH").otherwise("NEUTRAL"))


def news_momentum(x: DataFrame) -> DataFrame:
    """0..100 from sentiment drift, keyword balance, attention and level; under three articles it is neutral.
    x: key columns, n30, drift, bull, bear, volume_trend, s7."""
    tot = c("bull") + c("bear")
    kw = F.when(tot > 0, 50 + (c("bull") - c("bear")) / tot * 50).otherwise(50.0)
    vt = c("volume_trend")
    vol = F.when(vt >= 2, 80.0).when(vt >= 1.5, 70.0).when(vt >= 1, 55.0).when(vt >= 0.5, 45.0).otherwise(30.0)
    s = 0.30 * clip(50 + c("drift") * 50, 0, 100) + 0.30 * clip(kw, 0, 100) + 0.20 * vol + 0.20 * clip(50 + c("s7") * 50, 0, 100)
    return x.withColumn("news_score", F.when(c("n30") < 3, 50.0).otherwise(s))


def top_per_publisher(a: DataFrame, key: str, score: str, per: int = 4, total: int = 10) -> DataFrame:
    """Best `total` articles per instrument with at most `per` of one publisher; both cuts are ranked-window limits."""
    o = [c(score).desc(), c("doc_id")]
    x = a.withColumn("_p", F.row_number().over(Window.partitionBy(key, "publisher").orderBy(*o))).where(c("_p") <= per)
    return x.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*o))).where(c("position") <= total).drop("_p")


def clashing_titles(a: DataFrame, key: list[str], score: str, put, share: float = 0.45) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Titles (id, key, doc_id), copies (key, id), pairs (one, other) of numbered titles whose words overlap by more than `share` of the
    smaller set, `one` being the better ranked, and the numbers (key, id, sid), which ascend with the rank.

    Of the titles of a key with one set of words only the best ranked takes part: the others clash with it, or with what drops it. The
    titles of a key are dealt to blocks of about `BLOCK_WORDS` words and any two blocks meet in a task of their own, which looks words up
    in an index of its own rows. So what is shuffled is the words of a title once per block of its key and no row per word or per
    pair that meets; memory of a task is that of two blocks however many titles a key has. `put` writes a table and reads it again."""
    ws = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), "\\s+"), lambda w: F.length(w) > 3)))
    x = a.select(*key, "doc_id", c(score).alias("_s"), ws.alias("w")).withColumn("id", F.struct((-c("_s")).alias("o"), c("doc_id").alias("doc_id"))).drop("_s")
    x = put(x, "stories")
    keyed = x.where(F.size("w") > 0).dropna(subset=key)
    best = keyed.groupBy(*key, "w").agg(F.min("id").alias("id"))
    copies = keyed.join(best.withColumnRenamed("id", "_best"), [*key, "w"]).where("id > _best").select(*key, "id").distinct()
    best = put(best.orderBy("id").withColumn("sid", F.monotonically_increasing_id()), "story-sets")
    load = best.groupBy(*key).agg(F.sum(F.size("w") + TITLE_WORDS).alias("load"))
    load = put(load.withColumn("blocks", (1 + F.floor(c("load") / BLOCK_WORDS)).cast("int")), "story-blocks")
    cells, sent = load.agg(F.sum(c("blocks") * (c("blocks") + 1) / 2), F.sum(c("load") * c("blocks"))).first()
    parts = 1 + int(min(cells or 0, (sent or 0) // (BLOCK_WORDS // 16)))  # dealt by count: the planner does not see what a cell costs
    block = F.pmod(F.xxhash64("sid"), "blocks").cast("int")
    cut = best.join(load.drop("load"), key).select("*", block.alias("_block"), F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("_with"))
    cell = [*key, "_low", "_high"]
    cut = cut.select(*key, F.least("_block", "_with").alias("_low"), F.greatest("_block", "_with").alias("_high"), "_block", "sid", c("id.o").alias("_o"), c("id.doc_id").alias("_doc"), "w")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        sid, block, low, high = (rows[n].to_numpy() for n in ("sid", "_block", "_low", "_high"))
        o, doc = (rows[n].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for n in ("_o", "_doc"))
        for i, j in overlapping(rows["w"].combine_chunks(), o * (doc.max() + 1) + doc, (block != low).astype(np.int64), sid, share, bool(low[0] != high[0])):
            yield pa.RecordBatch.from_pydict({"one": np.minimum(sid[i], sid[j]), "other": np.maximum(sid[i], sid[j])})

    pairs = dealt(cut, parts, *cell).groupBy(*cell).applyInArrow(meet, "one long, other long")
    return x.select("id", *key, "doc_id"), copies, put(pairs, "story-pairs"), best.select(*key, "id", "sid")


def dedupe_stories(a: DataFrame, key: list[str], score: str, share: float = 0.45) -> DataFrame:
    """In rank order a title is dropped when its words overlap a kept title by more than `share` of the smaller set.

    What is kept is the first independent set of the clashing pairs in rank order. It is found in rounds over a written table: a title
    with no better undecided one among its pairs is kept, and its others are dropped. A day of any size is spread over all tasks;
    rounds are as many as the longest chain of titles that decide one another."""
    from tidemark.streaming.jobs import work_dir

    spark = a.sparkSession
    put = lambda df, name: (lambda path: (df.write.parquet(path), spark.read.schema(df.schema).parquet(path))[1])(work_dir(spark, name))
    titles, copies, left, sets = clashing_titles(a, key, score, put, share)
    gone = None
    while left.head(1):
        first = left.select(c("one").alias("sid")).join(left.select(c("other").alias("sid")), "sid", "left_anti").distinct()
        drop = put(left.join(first.withColumnRenamed("sid", "one"), "one", "left_semi").select(c("other").alias("sid")).distinct(), "story-drops")
        gone = drop if gone is None else gone.unionByName(drop)
        for end in ("one", "other"):
            left = left.join(drop.withColumnRenamed("sid", end), end, "left_anti")
        left = put(left.join(first.withColumnRenamed("sid", "one"), "one", "left_anti"), "story-pairs")
    out = copies if gone is None else copies.unionByName(sets.join(gone, "sid", "left_semi").select(*key, "id"))
    return titles.join(out, [*key, "id"], "left_anti").select(*key, "doc_id")


def stated_facts(a: DataFrame, key: str, text: str, order: str, groups: dict[str, tuple], hedges=T.HEDGES, first_only: str | None = None) -> DataFrame:
    """Sentences that state a figure or a direction without hedging, once per 55-character key, with their strongest group.
    `first_only` names a group whose words are common and count one less."""
    x = a.select(key, order, F.posexplode(T.sentences(c(text))).alias("pos", "s")).withColumn("low", F.lower("s"))
    figure = F.rlike("s", F.lit(r"(?i)\$\s?[\d,.]+|[\d,.]+\s?%|[\d,.]+\s?(x\b|times)|[\d,.]+\s*(billion|million|thousand)\b|\bQ[1-4]\s?20\d\d\b"))
    moved = F.rlike("s", F.lit(r"(?i)\b(declin\w+|fell|rose|surg\w+|dropp\w+|beat|missed|record|consecutive|all-time|highest|lowest|announc\w+|secur\w+|signed|launch\w+)\b"))
    vague = F.rlike("s", F.lit(r"(?i)^(the article|the piece|this article|it |they |which |that |where )"))
    x = x.where((figure | moved) & ~vague & ~T.has_any(c("low"), hedges))
    x = x.withColumn("k", F.substring(F.regexp_replace("low", "[^a-z0-9]", ""), 1, 55))
    sc = [F.struct((T.keyword_hits(c("low"), ws) - (F.least(F.lit(1), T.keyword_hits(c("low"), ws)) if g == first_only else 0)).alias("n"), F.lit(-i).alias("i"), F.lit(g).alias("g")) for i, (g, ws) in enumerate(groups.items())]
    x = x.withColumn("b", F.array_max(F.array(*sc))).where("b.n > 0")
    w = Window.partitionBy(key, "k").orderBy(order, "pos")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, order, "pos", c("s").alias("fact"), c("b.g").alias("grp"))


def subject_names(a: DataFrame, key: str, stop=(), share: float = 0.15) -> DataFrame:
    """Most common capitalised title token per instrument when it is in at least max(2, share of titles)."""
    n = a.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tok = a.select(key, F.explode(F.regexp_extract_all("title", F.lit(r"\b([A-Z][a-zA-Z'&.-]{2,})\b"), 1)).alias("t")).select(key, F.rtrim(F.lower("t"), F.lit(".'&-")).alias("t"))
    k = tok.where(~c("t").isin(*stop) if stop else F.lit(True)).groupBy(key, "t").agg(F.count(F.lit(1)).alias("k"))
    best = k.groupBy(key).agg(F.max(F.struct(c("k"), c("t"))).alias("b"))
    return best.join(n, key).where(c("b.k") >= F.greatest(F.lit(2.0), c("n") * share)).select(key, c("b.t").alias("name"), c("b.k").alias("mentions"))


# Words that name a market and not a company.
NOT_COMPANIES = ("the", "our", "we", "united states", "company", "inc", "and", "other", "these", "such", "including", "certain", "various", "many", "some", "europe", "asia", "america", "canada", "germany", "japan", "china", "india",
                 "australia", "france", "korea", "mexico", "brazil", "africa", "us", "uk", "middle east", "customers", "distributors", "retailers")


def relationships(docs: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, kind, name) from lists that follow a phrase of the business section: cut at the sentence end, split at commas
    and `and`, names are runs of capitalised words, once per kind."""
    x = docs.withColumn("_s", T.business_section(c(text)))
    found = [(kind, F.regexp_extract_all("_s", F.lit(f"(?i:{p})(.{{0,420}})"), 1)) for kind, p in patterns]
    runs = [F.arrays_zip(r.alias("run"), F.array_repeat(F.lit(kind), F.size(r)).alias("kind")) for kind, r in found]
    x = x.select(key, F.explode(F.concat(*runs)).alias("m"))
    run = F.element_at(F.split(c("m.run"), r"\.\s+[A-Z]|\band\s+others\b|\betc\b|\bamong\s+others\b"), 1)
    x = x.select(key, c("m.kind").alias("kind"), F.explode(F.split(run, r",|\band\b|;")).alias("part"))
    x = x.withColumn("part", F.trim(c("part"), F.lit(" .,;:()")))
    x = x.withColumn("name", F.regexp_extract("part", r"^[A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,3}", 0))
    return x.where((F.length("name") >= 3) & ~F.lower("name").isin(*NOT_COMPANIES)).select(key, "kind", "name").distinct()
