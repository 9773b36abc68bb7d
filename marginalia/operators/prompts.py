"""Prompts for labelers, their answers, and votes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import gating
from .config import canonical_json, options_of, repaired_json, response_schema, rules_of

KEY = ["unit_id", "label_id"]


def label_text(label_id: str, label: Mapping[str, Any]) -> str:
    """What a prompt says of one label."""
    options = options_of(label)
    return f"Label: {label_id}\nRules: {rules_of(label)}" + (f"\nOptions: {', '.join(options)}" if options else "")


def single_prompts(contexts: DataFrame, labels: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(unit_id, label_id, prompt, schema): one prompt for each label of each unit (unit_id, context), or for the pairs of contexts that has a label_id. A JVM template; labels are literals."""
    names = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.struct(F.lit(label_text(k, v)).alias("head"), F.lit(canonical_json(response_schema(v))).alias("schema")))])
    rows = contexts if "label_id" in contexts.columns else contexts.withColumn("label_id", F.explode(F.array(*[F.lit(k) for k in labels])))
    rows = rows.withColumn("_l", names[F.col("label_id")]).where("_l is not null")
    return rows.select(*KEY, F.concat("_l.head", F.lit("\n\nNotes:\n"), F.coalesce("context", F.lit(""))).alias("prompt"), F.col("_l.schema").alias("schema"))


def multi_prompts(contexts: DataFrame, labels: Mapping[str, Mapping[str, Any]], *, max_labels: int = 64, max_chars: int = 16_000) -> DataFrame:
    """(unit_id, part, labels, prompt): one prompt for all labels of a unit, max_labels of them in a part; contexts are cut to max_chars characters. Roots come before the labels that depend on them."""
    order = gating.prompt_order({k: dict(v) for k, v in labels.items()})
    parts = [order[i : i + max_labels] for i in range(0, len(order), max_labels)]
    line = lambda k: f"{k}: {rules_of(labels[k])}" + (f" Options: {', '.join(o)}" if (o := options_of(labels[k])) else "")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.array(*[F.lit(k) for k in p]).alias("labels"), F.lit("\n".join(map(line, p))).alias("head")) for i, p in enumerate(parts)]))
    body = F.substring(F.coalesce("context", F.lit("")), 1, max_chars)
    return contexts.select("unit_id", "context", each.alias("_p")).select("unit_id", "_p.part", "_p.labels", F.concat("_p.head", F.lit("\n\nNotes:\n"), body).alias("prompt"))


@F.pandas_udf(StringType())
def _repair(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None or (got := repaired_json(t)) is None else canonical_json(got))


def answer_json(answer: Column) -> Column:
    """The JSON object in a model's answer as text, null without one. Answers that are JSON stay in the JVM; only the others go to Python to be repaired."""
    clean = F.when(F.try_parse_json(F.trim(answer)).isNotNull() & F.trim(answer).startswith("{"), F.trim(answer))
    return F.coalesce(clean, _repair(F.when(clean.isNull(), answer)))


def split_answers(answers: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(unit_id, label_id, prediction_value): what one answer says of several labels; labels that it doesn't name, and answers without JSON, give none."""
    said = F.from_json(answer_json(F.col("answer")), "map<string,string>")
    rows = answers.select("unit_id", F.explode(said).alias("label_id", "prediction_value"))
    return rows.where(F.col("label_id").isin(*labels))


def call_json(rows: DataFrame, ask: Callable[[list[str]], list[str]], *, attempts: int = 2) -> DataFrame:
    """rows (unit_id, label_id, prompt) with answer: ask(prompts) in Arrow batches; prompts whose answer holds no JSON object are asked again, `attempts` times in all. An answer without one stays as it is."""

    def run(batches):
        for p in batches:
            got = [None] * len(p)
            todo = list(range(len(p)))
            for _ in range(attempts):
                for i, a in zip(todo, ask([p["prompt"].iloc[i] for i in todo]), strict=True):
                    got[i] = a
                todo = [i for i in todo if repaired_json(got[i]) is None]
                if not todo:
                    break
            yield pd.DataFrame({"unit_id": p["unit_id"], "label_id": p["label_id"], "answer": got})

    return rows.select(*KEY, "prompt").mapInPandas(run, "unit_id string, label_id string, answer string")


def route_of(label: Mapping[str, Any]) -> str:
    """forced_choice for a categorical or binary label of 2 to 26 options, which letters can name, else json."""
    kind = str(label.get("type", "categorical")).lower()
    return "forced_choice" if kind in ("categorical", "categorical_single", "binary", "boolean", "bool", "ordinal") and options_of(label, most=26) else "json"


def label_units(rows: DataFrame, labels: Mapping[str, Mapping[str, Any]], choose: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(unit_id, label_id, prediction_value, u): rows (unit_id, label_id, ...) by the route of their label: choose gives (.., prediction_value, entropy), answer (.., prediction_value, consistency).

    u is the entropy of the options, or 1 - consistency.
    """
    fc = [k for k, v in labels.items() if route_of(v) == "forced_choice"]
    picked = choose(rows.where(F.col("label_id").isin(*fc))).select(*KEY, "prediction_value", F.col("entropy").alias("u"))
    told = answer(rows.where(~F.col("label_id").isin(*fc))).select(*KEY, "prediction_value", (1.0 - F.coalesce("consistency", F.lit(0.0))).alias("u"))
    return picked.unionByName(told)


def family_batch(asked: DataFrame, parents: DataFrame, gates: Mapping, kinds: Mapping[str, str]) -> DataFrame:
    """The rows of asked (unit_id, label_id) whose label isn't gated or applies to the unit by its parents' predictions; others are left out."""
    ok = gating.eligibility(parents, dict(gates), dict(kinds)).withColumnRenamed("child", "label_id")
    return asked.join(ok, KEY, "left").where(~F.col("label_id").isin(*gates) | F.coalesce("eligible", F.lit(False))).drop("eligible")


def vote_snippets(snippets: DataFrame, votes: int, *, top: tuple[int, int], dropout: float, temperatures: tuple[float, float], seed) -> DataFrame:
    """(unit_id, label_id, vote, place, doc_id, chunk_id, temperature): what each vote on a pair sees of its snippets (rank from 0 or 1).

    A vote takes the best of them, between top[0] and top[1] by a keyed hash, leaves each but its first out
    with the share `dropout`, and has its own order and temperature. The same seed gives the same votes.
    """
    share = lambda *c: F.pmod(F.xxhash64(F.lit(str(seed)), *c), F.lit(1_000_003)) / 1_000_003.0
    v = F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote")
    who = [F.col(c) for c in (*KEY, "vote")]
    place = F.row_number().over(Window.partitionBy(*KEY, "vote").orderBy("rank", "doc_id", "chunk_id"))
    rows = snippets.select(*KEY, "doc_id", "chunk_id", "rank", v).withColumn("_n", place)
    k = top[0] + F.floor(share(F.lit("k"), *who) * (top[1] - top[0] + 1))
    kept = rows.where(F.col("_n") <= k).where((F.col("_n") == 1) | (share(F.lit("drop"), *who, "doc_id", "chunk_id") >= dropout))
    order = Window.partitionBy(*KEY, "vote").orderBy(share(F.lit("order"), *who, "doc_id", "chunk_id"), "doc_id", "chunk_id")
    heat = temperatures[0] + share(F.lit("heat"), *who) * (temperatures[1] - temperatures[0])
    return kept.select(*KEY, "vote", F.row_number().over(order).alias("place"), "doc_id", "chunk_id", F.round(heat, 6).alias("temperature"))


def task_lines(tasks: DataFrame) -> DataFrame:
    """One column `value`: each task as a JSON line."""
    return tasks.select(F.to_json(F.struct(*tasks.columns)).alias("value"))


def tasks_of(lines: DataFrame, schema: StructType) -> DataFrame:
    """Tasks that task_lines() wrote; a line that can't be read raises."""
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("t")).select("t.*")


