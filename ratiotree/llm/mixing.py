"""Sources mixed to target weights by iterative proportional fitting, with built-in functions alone.

Documents are summed to cells of source, language and topic; the cells' token weights are raked to each marginal in turn, and a
document is kept with its cell's calibrated probability. Steps are windows over cells, never over documents; every few rounds the cells
are written, and the largest relative error of any marginal's value says whether to go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: Rounds at most, rounds between two looks at the error, and the error that ends them.
ROUNDS, STEP, TOLERANCE = 200, 4, 1e-10
POWER, SEED = 0.7, 20

#: A topic by form, in SQL that Spark and DuckDB share.
TOPIC = """case when coalesce(text, '') = '' then 'empty' when contains(text, ' | ') then 'table'
 when contains(text, '%%%') or contains(text, '###') then 'marked' when length(text) < 600 then 'short'
 when length(text) < 4000 then 'medium' else 'long' end"""


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: str = TOPIC, power: float = POWER, rounds: int = ROUNDS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang, source, ...)``: doc_id, source, lang, topic, n_tokens, weight, probability, kept, residual.

    n_tokens counts the words at ASCII white space. ``targets`` gives a marginal's shares, as rows (value, share), for some of source,
    lang and topic; a value not listed gets none, and shares are scaled to those present. Without targets a value's share is its own to the ``power``, which
    lifts rare values. weight is the raked weight of a cell over its tokens, probability the weight over the largest weight,
    so that expected tokens are in proportion to the raked weights; kept if a number in [0, 1) made from doc_id and ``seed`` alone is
    below it. Null sources and languages are one value ``(none)``; documents without words have weight and probability 1 and are decided
    like others; repeated rows share their fate. Texts of any length count all their words; further columns are not read. An empty table gives an empty result.
    residual is the largest relative error that raking left in any marginal, the same on each row: rounds go on until it is below 1e-10, or to ``rounds``, where
    targets contradict each other. The largest weight of any cell sets the yield, so a rare cell that is lifted much lowers it for all, at the same proportions.
    ``carry``: instead, row (a struct of all columns of ``docs``), weight, probability, kept.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    space = " \t\n\x0b\x0c\r"
    body = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(space))
    tokens = F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "[\\x20\\x09-\\x0D]+"))).cast("long")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"_{c}") for c in ("source", "lang")]
    uniform = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = docs.select(F.struct(*docs.columns).alias("row") if carry else "doc_id", *named, F.expr(topic).alias("_topic"), tokens.alias("_tokens"), uniform.alias("_u"))
    rows = rows if carry else scratch.put(rows)
    cells = scratch.put(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").cast("double").alias("t")).where("t > 0"))
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    for m in MARGINS:
        values = cells.groupBy(f"_{m}").agg(F.sum("t").alias("t"))
        if targets and m in targets:
            values = values.join(targets[m].select(F.col("value").cast("string").alias(f"_{m}"), F.col("share").cast("double").alias("p")), f"_{m}", "left").fillna(0.0, ["p"])
        else:
            values = values.withColumn("p", F.pow(F.col("t") / total, F.lit(power)))
        values = scratch.put(values.select(f"_{m}", "p"))
        scale = total / (values.agg(F.sum("p")).first()[0] or 1.0)
        cells = cells.join(values.select(f"_{m}", (F.col("p") * scale).alias(f"p_{m}")), f"_{m}")
    cells = scratch.put(cells.withColumn("w", F.col("t")))
    done, residual = 0, 0.0
    while done < rounds:
        before = cells
        for _ in range(min(STEP, rounds - done)):
            for m in MARGINS:
                cells = cells.withColumn("w", F.expr(f"coalesce(w * p_{m} / nullif(sum(w) over (partition by _{m}), 0), 0)"))
        done += STEP
        cells = scratch.put(cells)
        scratch.drop(before)
        errors = [F.expr(f"coalesce(abs(sum(w) over (partition by _{m}) / nullif(p_{m}, 0) - 1), 0)") for m in MARGINS]
        residual = cells.select(F.greatest(*errors).alias("e")).agg(F.max("e")).first()[0] or 0.0
        if residual <= TOLERANCE:
            break
    cells = scratch.put(cells.select("_source", "_lang", "_topic", (F.col("w") / F.col("t")).alias("f")))
    top = cells.agg(F.max("f")).first()[0] or 1.0
    cells = cells.select("_source", "_lang", "_topic", F.round("f", 9).alias("weight"), F.round(F.col("f") / top, 9).alias("probability"))
    out = rows.join(cells, ["_source", "_lang", "_topic"], "left").fillna(1.0, ["weight", "probability"]).withColumn("kept", F.col("_u") < F.col("probability"))
    if carry:
        return out.select("row", "weight", "probability", "kept")
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "probability", "kept", F.lit(round(float(residual), 6)).alias("residual"))


def sql(power: float = POWER, rounds: int = 40, seed: int = SEED) -> str:
    """The same without targets, for DuckDB; so many rounds leave no error on the example tables."""
    steps, last = [], "cells"
    for m in MARGINS:
        steps.append(f"v_{m} as (select {m}, pow(sum(t) / (select sum(t) from cells), {power}) as p from cells group by {m})")
        steps.append(f"c_{m} as (select c.*, p * (select sum(t) from cells) / (select sum(p) from v_{m}) as p_{m} from {last} c join v_{m} using ({m}))")
        last = f"c_{m}"
    steps.append(f"w0 as (select *, t as w from {last})")
    last = "w0"
    for i in range(rounds * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        steps.append(f"w{i + 1} as materialized (select * replace (coalesce(w * p_{m} / nullif(sum(w) over (partition by {m}), 0), 0) as w) from {last})")
        last = f"w{i + 1}"
    return f"""
with d as materialized (
  select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, {TOPIC} as topic,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens,
         cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':{seed}'), 1, 8)) as bigint) / 4294967296.0 as u
  from documents
), cells as materialized (select source, lang, topic, cast(sum(n_tokens) as double) as t from d group by all having sum(n_tokens) > 0),
{", ".join(steps)}, f as (select source, lang, topic, w / t as f from {last}), left_over as (select max(greatest({", ".join(f"e_{m}" for m in MARGINS)})) as residual from (
  select {", ".join(f"coalesce(abs(sum(w) over (partition by {m}) / nullif(p_{m}, 0) - 1), 0) as e_{m}" for m in MARGINS)} from {last}))
select doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(round(f, 9), 1.0) as weight,
       coalesce(round(f / (select max(f) from f), 9), 1.0) as probability, u < coalesce(round(f / (select max(f) from f), 9), 1.0) as kept,
       round((select residual from left_over), 6) as residual
from d left join f using (source, lang, topic)
"""
