"""Conversations from reply trees.

A message names its parent. Self-joins that double the distance each time find every message's root, depth and the score of the
way to it; the best leaf of each tree is chosen, and the tables of the same joins, read backwards, mark the messages on its way. So a
tree of depth d takes about 2 log d joins, and only chosen messages are gathered, one conversation to a row.

The template puts ``<s>[ROLE]role[/ROLE]`` before and ``</s>`` after each text. In texts and roles the signs ``\\``, ``<`` and ``[``
become ``\\\\``, ``\\l`` and ``\\b``, so none of the template's strings can appear there, and all of it can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_IN = {"\\": "\\", "l": "<", "b": "["}
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _IN[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where the texts of the assistant stand in it."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
        if role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        out.append(f"{head}{body}</s>")
        n += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of what ``render`` returned."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def best_paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root, depth) of the messages on the best way from each root to a leaf.

    ``messages``: id, parent (null at a root), score; ids are unique. A branch's score is the sum over its messages, null as 0; ties go to the
    smaller leaf id. Messages whose parent is missing are roots; messages on a cycle have no root and are left out.
    """
    own = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = own.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    first = scratch.put(own.join(parents, "parent", "left").select("id", up.alias("up"), up.isNotNull().cast("long").alias("steps"), "score", F.when(up.isNull(), F.col("id")).alias("root")))
    size = first.count()
    reached, live, jumps = first.where("up is null"), first.where("up is not null"), []
    while True:
        n, deepest = live.agg(F.count(F.lit(1)), F.max("steps")).first()
        if not n or deepest > 2 * size:  # none left, or cycles alone
            break
        jumps.append(live.select("id", "up"))
        over = reached.union(live).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"), F.col("root").alias("root2"))
        new = live.join(over, "up").select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score"), F.col("root2").alias("root"))
        new = scratch.put(new)  # messages that have reached their root take no part in later joins
        reached, live = reached.union(new.where("up is null")), new.where("up is not null")
    leaves = reached.join(own.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    on = leaves.groupBy("root").agg(F.min(F.struct((-F.col("score")).alias("worse"), "id")).alias("best")).select(F.col("best.id").alias("id"), "root")
    for jump in reversed(jumps):
        on = scratch.put(on.union(on.join(jump, "id").select(F.col("up").alias("id"), "root")))
    return on.join(reached.select("id", F.col("steps").alias("depth")), "id")


def format_trees(messages: DataFrame) -> DataFrame:
    """(tree, formatted, loss array<struct<start,end>>): the best branch of each reply tree as one conversation.

    ``messages``: id, parent, score, tree (any name for the root's tree), role, text; null roles and texts count as empty. A conversation is one
    row, so one task holds the chosen branch of a tree at a time, whatever its length; texts of any length are escaped whole. Further columns are not read.
    An empty table gives no rows.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.put(messages.select("id", "parent", "score", "tree", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    chosen = best_paths(messages, scratch)
    rows = messages.drop("parent", "score").join(chosen, "id")
    trees = rows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"), F.min_by("tree", "depth").alias("tree"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in part["turns"]]
            yield pd.DataFrame({"tree": part["tree"], "formatted": [x for x, _ in done], "loss": [[{"start": a, "end": b} for a, b in s] for _, s in done]})

    kind = messages.schema["tree"].dataType.simpleString()
    return trees.select("tree", "turns").mapInPandas(run, f"tree {kind}, formatted string, loss array<struct<start:long,end:long>>")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of trees with one branch: the rows of ``conversations(conv_id, turn, role, text)`` by turn, each answering the one before.

    Rows of one turn follow by role, then text; repeated rows stay. A null conv_id is one more conversation, a null turn comes first.
    """
    key = "coalesce(cast(conv_id as string), 'null')"
    at = F.expr("row_number() over (partition by conv_id order by turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("at", at).select(
        F.expr(f"concat({key}, ':', at)").alias("id"), F.expr(f"if(at > 1, concat({key}, ':', at - 1), null)").alias("parent"),
        F.lit(0.0).alias("score"), F.col("conv_id").alias("tree"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the output of ``format_trees``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, loss in zip(part["formatted"], part["loss"], strict=True):
                turns = parse(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pd.DataFrame({"conv_id": part["tree"].astype("Int64"), **dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), columns, strict=True))})

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What ``read_back`` gives for chains, from the rows themselves.
SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
  select *, replace(replace(replace(role, '\', '\'), '<', '\l'), '[', '\b') as er, replace(replace(replace(text, '\', '\'), '<', '\l'), '[', '\b') as et from rows
)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<s>[ROLE]') + length(er) + length('[/ROLE]') + length(et) + length('</s>')) as bigint) as formatted_chars
from e group by conv_id
"""
