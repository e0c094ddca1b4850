"""URL filter by a path-template tree (operator 2). DataFrame functions only.

Per host, paths are laid out as a tree. Digit runs become `{n}` at once; a node with many children that are mostly its only pages
(`MANY` at least, more than half as many as pages) has its child replaced by `*`. The templates that result are compared with their
family, the same shape with every literal segment as `*`: a branch whose labelled purity does not differ from the family's (two
proportions, `Z`) is merged into it. A template's purity is smoothed towards the share of good labels in the corpus with the weight of
`ALPHA` labels, and templates below `MIN_PURITY` are rejected. Rules on host and path prefix come first; the longest that fits wins.

Statistics are summed per (host, path with digits generalised) on the map side before the tree is built, so a host with a third of
all pages is a few rows from there on. The tree has as many levels as the paths have.

Rows: a null url or one without `://` has an empty host and path and is judged like any other; pages without label only count as
pages. Repeated pages count each. Repeated labels of one document: the lowest holds. An empty table gives no rows. Extra columns of
pages are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANY, Z, ALPHA, MIN_PURITY = 20, 1.96, 10.0, 0.75
#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and its subdomains, path prefix) and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def templates(shapes: DataFrame, prior: float, many: int = MANY, z: float = Z, alpha: float = ALPHA, min_purity: float = MIN_PURITY) -> DataFrame:
    """Per (host, shape) of the rows (host, shape, pages, labelled, good): template, purity and the method's verdict."""
    levels = shapes.select("host", "shape", "pages", F.posexplode(F.split("shape", "/", -1)).alias("level", "segment"))
    above = F.array_join(F.slice(F.split("shape", "/", -1), F.lit(1), F.col("level")), "/")
    levels = levels.withColumn("above", above)
    children = levels.groupBy("host", "level", "above", "segment").agg(F.sum("pages").alias("pages"))
    nodes = children.groupBy("host", "level", "above").agg(F.count("*").alias("n"), F.sum("pages").alias("of"))
    wild = nodes.filter((F.col("n") >= many) & (F.col("n") * 2 > F.col("of"))).select("host", "level", "above", F.lit(True).alias("wild"))
    named = levels.join(wild, ["host", "level", "above"], "left").withColumn("segment", F.when(F.col("wild"), "*").otherwise(F.col("segment")))
    named = named.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("level", "segment"))).alias("path"))
    rows = shapes.join(named.select("host", "shape", F.array_join(F.col("path.segment"), "/").alias("template")), ["host", "shape"])

    leaves = rows.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
    family = F.array_join(F.transform(F.split("template", "/", -1), lambda s: F.when((s == "") | s.contains("{n}"), s).otherwise(F.lit("*"))), "/")
    leaves = leaves.withColumn("family", family)
    families = leaves.groupBy("host", "family").agg(F.sum("n").alias("fn"), F.sum("g").alias("fg"))
    leaves = leaves.join(families, ["host", "family"])
    p = F.try_divide("fg", "fn")
    gap = F.abs(F.try_divide("g", "n") - p)
    alike = (F.col("n") == 0) | (gap * gap <= F.lit(z * z) * p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), F.col("fn"))))
    leaves = leaves.withColumn("final", F.when(alike, F.col("family")).otherwise(F.col("template")))
    pooled = leaves.groupBy("host", "final").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    pooled = pooled.select("host", "final", ((F.col("g") + F.lit(alpha * prior)) / (F.col("n") + F.lit(alpha))).alias("purity"))
    judged = leaves.select("host", "template", "final").join(pooled, ["host", "final"])
    return rows.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", F.col("final").alias("template"), "purity", F.when(F.col("purity") < min_purity, "block").otherwise("allow").alias("method"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page. `labels`: doc_id, quality; the last number in a path names the document."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("doc_id", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?\\z', 1) as bigint)"))
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the last number is looked up once per document, not once per page
    numbers = rows.groupBy("host", "shape", "doc_id").agg(F.count("*").alias("pages")).join(known, "doc_id", "left")
    shapes = numbers.groupBy("host", "shape").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.when(F.col("quality").isNotNull(), F.col("pages")).otherwise(0)).alias("labelled"),
        F.sum(F.when(F.col("quality") == 1, F.col("pages")).otherwise(0)).alias("good"),
    )
    total = shapes.agg(F.sum("good").alias("g"), F.sum("labelled").alias("n")).first()
    prior = total["g"] / total["n"] if total["n"] else 1.0
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = rows.join(templates(shapes, prior), ["host", "shape"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method")).alias("verdict"), "template", "purity")


def oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(p.path, '{p}'))", h + p, what) for what, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    p AS (SELECT *, TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9/]*/?\\z', 1) AS BIGINT) AS doc_id, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM r),
    k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    s AS (SELECT host, shape, count(*) AS pages, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good FROM p LEFT JOIN k USING (doc_id) GROUP BY host, shape),
    prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good)::DOUBLE / sum(labelled)::DOUBLE ELSE 1.0 END AS prior FROM s),
    l AS (SELECT host, shape, pages, string_split(shape, '/') AS segs, unnest(range(len(string_split(shape, '/')))) AS level FROM s),
    l2 AS (SELECT *, segs[level + 1] AS segment, array_to_string(segs[1:level], '/') AS above FROM l),
    c AS (SELECT host, level, above, segment, sum(pages) AS pages FROM l2 GROUP BY ALL),
    w AS (SELECT host, level, above FROM c GROUP BY ALL HAVING count(*) >= {MANY} AND count(*) * 2 > sum(pages)),
    t AS (SELECT l2.host, l2.shape, string_agg(CASE WHEN w.host IS NOT NULL THEN '*' ELSE l2.segment END, '/' ORDER BY l2.level) AS template
          FROM l2 LEFT JOIN w ON l2.host = w.host AND l2.level = w.level AND l2.above = w.above GROUP BY l2.host, l2.shape),
    x AS (SELECT s.*, t.template FROM s JOIN t USING (host, shape)),
    lf AS (SELECT host, template, sum(labelled)::DOUBLE AS n, sum(good)::DOUBLE AS g,
                  array_to_string(list_transform(string_split(template, '/'), lambda v: CASE WHEN v = '' OR contains(v, '{{n}}') THEN v ELSE '*' END), '/') AS family FROM x GROUP BY host, template),
    fm AS (SELECT host, family, sum(n) AS fn, sum(g) AS fg FROM lf GROUP BY host, family),
    le AS (SELECT lf.*, CASE WHEN n = 0 OR abs(g / n - fg / fn) * abs(g / n - fg / fn) <= {Z * Z} * (fg / fn) * (1 - fg / fn) * (1.0::DOUBLE / n + 1.0::DOUBLE / fn) THEN lf.family ELSE template END AS final FROM lf JOIN fm ON lf.host = fm.host AND lf.family = fm.family),
    po AS (SELECT host, final, (sum(g) + {ALPHA} * (SELECT prior FROM prior)) / (sum(n) + {ALPHA}) AS purity FROM le GROUP BY host, final)
    SELECT p.page_id, p.host, p.path, {rule} AS rule, coalesce({verdict}, CASE WHEN po.purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, po.final AS template, po.purity
    FROM p JOIN x ON p.host = x.host AND p.shape = x.shape JOIN le ON x.host = le.host AND x.template = le.template JOIN po ON le.host = po.host AND le.final = po.final"""
