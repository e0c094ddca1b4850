"""Preference formatting (operator 5): the common beginning of a chosen and a rejected conversation is rendered once.

The longest common prefix of turns (role and text equal) becomes the prompt; what follows on either side is a completion with a
run-length mask over its code points: `length:1` is trained on (the text and end mark of assistant turns), `length:0` is not.

Work is done per pair in array functions; a task holds single conversations only.

Rows: turns are ordered by number, role and text, so repeated turn numbers have one order; null roles and texts are rendered as empty
and compared as nulls. Turns without a conversation id belong to no conversation and are left out. Equal sides have the whole
conversation as prompt and empty completions. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _header(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    runs = lambda t: F.concat(F.length(_header(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), F.when(t["role"] == "assistant", ":1").otherwise(":0"))
    return F.array_join(F.transform(turns, runs), ",")


def format_preferences(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Of rows with two arrays of (role, text): key, n_prefix, prompt, both completions and their masks."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    rows = pairs.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long"))
    rest = {c: F.slice(F.col(c), F.col("n_prefix").cast("int") + 1, F.size(c) + 1) for c in (chosen, rejected)}
    return rows.select(
        key,
        "n_prefix",
        rendered(F.slice(F.col(chosen), F.lit(1), F.col("n_prefix").cast("int"))).alias("prompt"),
        *(rendered(rest[c]).alias(c) for c in rest),
        *(mask(rest[c]).alias(f"{c}_mask") for c in rest),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """A pair from every conversation: it is chosen as it stands up to its last assistant turn; in the rejected one that turn repeats
    the assistant turn before (empty if there is none). Without any assistant turn both are the whole conversation."""
    rows = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.select("conv_id", plain.alias("turns")).withColumn("spoken", F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull()))
    last = F.try_element_at("spoken", F.lit(-1))
    earlier = F.when(F.size("spoken") > 1, F.try_element_at("turns", F.coalesce(F.try_element_at("spoken", F.lit(-2)), F.lit(1)))["text"]).otherwise(F.lit(""))
    some = F.size("spoken") > 0
    chosen = F.when(some, F.slice("turns", F.lit(1), F.coalesce(last, F.lit(0)))).otherwise(F.col("turns"))
    rejected = F.when(some, F.concat(F.slice("turns", F.lit(1), F.coalesce(last - 1, F.lit(0))), F.array(F.struct(F.lit("assistant").alias("role"), earlier.alias("text"))))).otherwise(F.col("turns"))
    return rows.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def oracle() -> str:
    header = "('<|' || coalesce(t.role, '') || '|>' || chr(10))"
    body = "(coalesce(t.text, '') || '<|end|>' || chr(10))"
    render = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: {header} || {body}), ''), '')"
    masked = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: length({header}) || ':0,' || length({body}) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), ','), '')"
    return f"""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
    a AS (SELECT conv_id, max(i) AS last FROM o WHERE role = 'assistant' GROUP BY conv_id),
    e AS (SELECT o.conv_id, max_by(coalesce(o.text, chr(0)), o.i) AS earlier FROM o JOIN a USING (conv_id) WHERE o.role = 'assistant' AND o.i < a.last GROUP BY o.conv_id),
    c AS (SELECT o.conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS chosen,
                 list(CASE WHEN i = last THEN struct_pack(role := 'assistant', text := CASE WHEN earlier = chr(0) THEN NULL ELSE coalesce(earlier, '') END) ELSE struct_pack(role := role, text := text) END ORDER BY i) AS rejected
          FROM o LEFT JOIN a USING (conv_id) LEFT JOIN e USING (conv_id) WHERE a.last IS NULL OR i <= a.last GROUP BY o.conv_id),
    n AS (SELECT *, CAST(len(chosen) - CASE WHEN chosen[len(chosen)] IS DISTINCT FROM rejected[len(rejected)] THEN 1 ELSE 0 END AS BIGINT) AS n_prefix FROM c)
    SELECT conv_id, n_prefix, {render('chosen[1:n_prefix]')} AS prompt, {render('chosen[n_prefix + 1:]')} AS chosen, {render('rejected[n_prefix + 1:]')} AS rejected,
           {masked('chosen[n_prefix + 1:]')} AS chosen_mask, {masked('rejected[n_prefix + 1:]')} AS rejected_mask FROM n"""
