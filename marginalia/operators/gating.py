"""Label gating: an expression parser, the label graph, and eligibility of child labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

_RULE = re.compile(r"""^\s*(?P<field>.+?)\s*(?P<op>==|!=|>=|<=|>|<|\bnot\s+in\b|\bin\b|\bnot\s+contains\b|\bcontains\b|\bexists\b)\s*(?P<value>.*?)\s*$""", re.I)
_QUOTED = re.compile(r"""'([^']*)'|"([^"]*)"|([^,()\s][^,()]*)""")


def parse_gate(expression: str) -> tuple[str, list[dict]]:
    """("AND" or "OR", rules) of a gating expression; a mix of both counts as AND. Quotes protect the words and, or."""
    parts, words, cur, quote = [], [], "", None
    for token in re.split(r"""(\s+(?:and|or)\s+|['"])""", expression, flags=re.I):
        if token in ("'", '"'):
            quote = None if quote == token else quote or token
            cur += token
        elif quote is None and re.fullmatch(r"\s+(?:and|or)\s+", token, re.I):
            parts.append(cur)
            words.append(token.strip().upper())
            cur = ""
        else:
            cur += token
    rules = []
    for p in [*parts, cur]:
        m = _RULE.match(p)
        if not m:
            continue
        op = re.sub(r"\s+", "", m["op"].lower())
        values = [next(g for g in x.groups() if g is not None).strip() for x in _QUOTED.finditer(m["value"])]
        rules.append({"field": m["field"].strip().strip("'\""), "op": op, "values": values})
    return ("OR" if words and set(words) == {"OR"} else "AND"), rules


def rule_holds(rule: dict, kind: str, value: Column, *, require_parent: bool = False) -> Column:
    """Whether a parent's value meets a rule. A missing number or date meets none; a missing text counts as empty, or meets none with require_parent."""
    op, values = rule["op"], rule["values"]
    if op in ("exists", "notnull"):
        return F.coalesce(text.nonblank(value).isNotNull(), F.lit(False))
    if kind in ("numeric", "date"):
        read = dates.parse_number if kind == "numeric" else dates.parse_date
        v, want = read(value), [read(F.lit(x)) for x in values]
        out = {
            "==": lambda: v == want[0],
            "!=": lambda: v != want[0],
            ">": lambda: v > want[0],
            ">=": lambda: v >= want[0],
            "<": lambda: v < want[0],
            "<=": lambda: v <= want[0],
            "between": lambda: (v >= want[0]) & (v <= want[1]),
            "in": lambda: v.isin(*want),
            "notin": lambda: ~v.isin(*want),
        }[op]()
        return F.coalesce(out, F.lit(False))
    v = F.coalesce(F.lower(F.trim(value)), F.lit(""))
    low = [x.lower() for x in values]
    has = text.multi_set(value)
    inside = F.arrays_overlap(has, F.array(*[F.lit(x) for x in low])) if low else F.lit(False)
    out = {"==": v.isin(*low[:1]), "in": v.isin(*low) | inside, "contains": inside, "!=": ~v.isin(*low[:1]), "notin": ~(v.isin(*low) | inside), "notcontains": ~inside}[op]
    return out & (v != "") if require_parent else out


def topological(parents: dict[str, list[str]]) -> list[str]:
    """Labels, parents first and otherwise sorted; a cycle raises."""
    out: list[str] = []
    left = {k: set(v) for k, v in parents.items()} | {p: set() for v in parents.values() for p in v if p not in parents}
    while left:
        free = sorted(k for k, v in left.items() if not v - set(out))
        if not free:
            raise ValueError(f"labels depend on each other: {sorted(left)}")
        out += free
        for k in free:
            del left[k]
    return out


def label_graph(labels: dict[str, dict]) -> tuple[dict[str, list[str]], dict[str, list[str]], list[str]]:
    """(children by parent, parents by child, roots) of label configurations, by the labels that their gating_expr names; names that are no label of the set are left out."""
    names = {str(v.get("name") or k).lower(): k for k, v in labels.items()} | {k.lower(): k for k in labels}
    parents = {}
    for k, v in labels.items():
        _, rules = parse_gate(v.get("gating_expr") or "")
        parents[k] = sorted({names[r["field"].lower()] for r in rules if r["field"].lower() in names} - {k})
    children: dict[str, list[str]] = {}
    for k in sorted(parents):
        for p in parents[k]:
            children.setdefault(p, []).append(k)
    return children, {k: v for k, v in parents.items() if v}, sorted(k for k, v in parents.items() if not v)


def ancestors(parents: dict[str, list[str]], label: str) -> list[str]:
    """All labels that a label depends on, nearest first; a cycle ends where it closes."""
    out, front = [], list(parents.get(label, ()))
    while front:
        p = front.pop(0)
        if p != label and p not in out:
            out.append(p)
            front += parents.get(p, ())
    return out


def dependency_tree(children: dict[str, list[str]], roots: list[str]) -> list[dict]:
    """Nested {label, children} from the roots down; a label that is above itself is marked and not followed."""

    def below(k: str, above: tuple[str, ...]) -> dict:
        if k in above:
            return {"label": k, "cycle": True, "children": []}
        return {"label": k, "children": [below(c, (*above, k)) for c in children.get(k, ())]}

    return [below(r, ()) for r in roots]


def prompt_order(labels: dict[str, dict]) -> list[str]:
    """Labels for a prompt: roots, then the others, each sorted."""
    _, _, roots = label_graph(labels)
    return roots + sorted(set(labels) - set(roots))


def eligibility(values: DataFrame, gates: dict[str, tuple[str, list[dict]]], kinds: dict[str, str], *, label: str = "label_id", value: str = "prediction_value", require_parent: bool = False) -> DataFrame:
    """(unit_id, child, eligible) for each unit and gated label; rules name their parent label as field."""
    need = sorted({r["field"] for _, rules in gates.values() for r in rules})
    wide = values.groupBy("unit_id").agg(*[F.min(F.when(F.col(label) == p, F.col(value))).alias(f"_{i}") for i, p in enumerate(need)])
    rows = []
    for child, (logic, rules) in sorted(gates.items()):
        ok = [rule_holds(r, kinds.get(r["field"], "categorical"), F.col(f"_{need.index(r['field'])}"), require_parent=require_parent) for r in rules]
        both = F.lit(True) if not ok else ok[0]
        for x in ok[1:]:
            both = both | x if logic == "OR" else both & x
        rows.append(F.struct(F.lit(child).alias("child"), both.alias("eligible")))
    return wide.select("unit_id", F.explode(F.array(*rows)).alias("x")).select("unit_id", "x.*")


def gated_predictions(pred: DataFrame, gates: dict, kinds: dict[str, str]) -> DataFrame:
    """pred with prediction_value null where its label is gated and the unit isn't eligible."""
    ok = eligibility(pred, gates, kinds).withColumnRenamed("child", "label_id")
    return pred.join(ok, ["unit_id", "label_id"], "left").withColumn("prediction_value", F.when(F.coalesce("eligible", F.lit(True)), F.col("prediction_value"))).drop("eligible")


def completion(ann: DataFrame, required: list[str], gates: dict, kinds: dict[str, str]) -> DataFrame:
    """(unit_id, reviewer_id, complete): whether each required label that is visible has a value or na."""
    has = F.coalesce(F.col("na"), F.lit(False)) | F.coalesce(text.nonblank(F.col("label_value")).isNotNull(), F.lit(False)) | F.col("label_value_num").isNotNull() | F.col("label_value_date").isNotNull()
    who = F.struct("unit_id", "reviewer_id")
    seen = eligibility(ann.select(who.alias("unit_id"), "label_id", F.col("label_value").alias("prediction_value")), gates, kinds).withColumnRenamed("child", "label_id")
    done = ann.groupBy(who.alias("unit_id"), "label_id").agg(F.max(has).alias("has"))
    units = done.select("unit_id").distinct().withColumn("label_id", F.explode(F.array(*[F.lit(x) for x in required])))
    all_ = units.join(done, ["unit_id", "label_id"], "left").join(seen, ["unit_id", "label_id"], "left")
    ok = F.coalesce("has", F.lit(False)) | ~F.coalesce("eligible", F.lit(True))
    return all_.groupBy("unit_id").agg(F.min(ok).alias("complete")).select("unit_id.*", "complete")
