"""Label configurations on the driver: merging, rules, options, queries, exemplars, schemas and few-shot messages."""

from __future__ import annotations

import ast
import copy
import dataclasses
import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from itertools import zip_longest
from typing import Any

#: Settings that a backend is built from: experiments that differ in none of them share one.
BACKEND_KEYS = ("backend", "model", "model_dir", "endpoint", "embed_model", "rerank_model", "index", "device")
RULE_KEYS = ("rule", "rules", "why", "query", "text")


def deep_merged(base: Any, over: Mapping[str, Any]) -> Any:
    """A copy of base, a mapping or dataclass, with `over` laid on it level by level. Names that a dataclass lacks raise."""
    if dataclasses.is_dataclass(base):
        if unknown := set(over) - {f.name for f in dataclasses.fields(base)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        nested = {k: deep_merged(getattr(base, k), v) if _nested(getattr(base, k)) and isinstance(v, Mapping) else copy.deepcopy(v) for k, v in over.items()}
        return dataclasses.replace(base, **nested)
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = deep_merged(out[k], v) if _nested(out.get(k)) and isinstance(v, Mapping) else copy.deepcopy(v)
    return out


def _nested(x: Any) -> bool:
    return isinstance(x, Mapping) or (dataclasses.is_dataclass(x) and not isinstance(x, type))


def normal_overrides(over: Mapping[str, Any], renames: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Overrides under their present names, at every level: per_label_topk is top_k_final; paths of models lose blanks and closing slashes."""
    renames = {"per_label_topk": "top_k_final"} | dict(renames or {})
    out: dict[str, Any] = {}
    for k, v in over.items():
        name = renames.get(k, k)
        if isinstance(v, Mapping):
            v = normal_overrides(v, renames)
        elif isinstance(v, str) and name.endswith(("_dir", "_path", "_model")):
            v = v.strip().rstrip("/") or None
        if name not in out or k == name:
            out[name] = v
    return out


def shares_backend(a: Mapping[str, Any], b: Mapping[str, Any]) -> bool:
    """Whether two settings differ in nothing that a backend is built from, at any level."""

    def own(x: Mapping[str, Any]) -> dict[str, Any]:
        return {k: v if k in BACKEND_KEYS else own(v) for k, v in x.items() if k in BACKEND_KEYS or (isinstance(v, Mapping) and own(v))}

    return canonical_json(own(a)) == canonical_json(own(b))


def canonical_json(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def config_hash(x: Any) -> str:
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def rules_of(label: Mapping[str, Any]) -> str:
    """The label's rule: the first of RULE_KEYS that holds text, of a list its last item that does."""
    for k in RULE_KEYS:
        v = label.get(k)
        items = v if isinstance(v, (list, tuple)) else [v]
        for x in reversed(items):
            if isinstance(x, Mapping):
                x = x.get("text") or x.get("rule")
            if x is not None and str(x).strip():
                return str(x).strip()
    return ""


def options_of(label: Mapping[str, Any], *, most: int | None = None) -> list[str]:
    """A label's options as text, each once; yes and no for a binary one without. With `most`, none unless there are 2 to `most`, as letters can name."""
    found = [x.get("value") if isinstance(x, Mapping) else x for x in label.get("options") or ()]
    out = list(dict.fromkeys(str(x).strip() for x in found if x is not None and str(x).strip()))
    if not out and str(label.get("type", "")).lower() in ("binary", "boolean", "bool"):
        out = ["yes", "no"]
    return out if most is None or 2 <= len(out) <= most else []


def keywords_of(label_id: str, label: Mapping[str, Any], settings: Mapping[str, Any]) -> list[str]:
    """Keywords from the settings for all labels, those for this one, and the label's own, in that order, each once whatever its case."""
    every = [*(settings.get("keywords") or ()), *((settings.get("label_keywords") or {}).get(label_id) or ()), *(label.get("keywords") or ())]
    out: dict[str, str] = {}
    for k in map(str, every):
        if k.strip():
            out.setdefault(k.strip().lower(), k.strip())
    return list(out.values())


def exemplars_of(label: Mapping[str, Any], k: int | None = None, generate: Callable[[str, str, int], Sequence[str]] | None = None) -> list[str]:
    """Texts that a note with the label may hold: `generate` gives some for each option, taken in turns; without it they are made from the rules. max(k or 6, options) at most."""
    options, rules = options_of(label) or [""], rules_of(label)
    want = max(k or 6, len(options))
    made = [list(generate(rules, o, want)) if generate else [" ".join(x for x in (str(label.get("name") or label.get("label_id") or ""), o, rules) if x)] for o in options]
    turns = [x.strip() for row in zip_longest(*made) for x in row if x and x.strip()]
    return list(dict.fromkeys(turns))[:want]


def search_queries(label: Mapping[str, Any], *, exemplars: Sequence[str] = (), k: int | None = None) -> tuple[str, list[str]]:
    """(source, queries): a query given by hand ("manual"), else exemplars, at most max(k or 6, options) ("exemplars"), else the rules ("rules")."""
    for name in ("search_query", "rag_query"):
        if str(label.get(name) or "").strip():
            return "manual", [str(label[name]).strip()]
    if exemplars:
        return "exemplars", list(exemplars)[: max(k or 6, len(options_of(label)))]
    text = rules_of(label) or str(label.get("name") or "")
    return "rules", [text] if text else []


def rerank_query(rules: str, paraphrase: Callable[[str], str] | None = None, limit: int = 150) -> str:
    """Rules of up to `limit` characters as they are, longer ones shortened by the caller's function where there is one and it gives something."""
    return (paraphrase(rules) or rules) if paraphrase and len(rules) > limit else rules


def few_shot(examples: Sequence[Mapping[str, Any]]) -> list[dict[str, str]]:
    """User and assistant messages of examples (context or text, answer); an answer that is no text becomes canonical JSON, one without is left out."""
    out = []
    for e in examples:
        context, answer = str(e.get("context") or e.get("text") or "").strip(), e.get("answer", e.get("label"))
        if not context or answer is None or answer == "":
            continue
        said = answer.strip() if isinstance(answer, str) else canonical_json(answer)
        out += [{"role": "user", "content": context}, {"role": "assistant", "content": said}]
    return out


def response_schema(label: Mapping[str, Any], *, reasoning: bool = False) -> dict[str, Any]:
    """JSON schema of an answer by label type; null is allowed where na is."""
    kind, options = str(label.get("type", "")).lower(), options_of(label)
    if kind in ("numeric", "number", "float", "integer"):
        value: dict[str, Any] = {"type": ["integer" if kind == "integer" else "number"]}
    elif kind == "categorical_multi":
        value = {"type": ["array"], "items": {"type": "string", **({"enum": options} if options else {})}}
    elif kind == "date":
        value = {"type": ["string"], "format": "date"}
    else:
        value = {"type": ["string"], **({"enum": options} if options else {})}
    if label.get("na_allowed"):
        value["type"].append("null")
        if "enum" in value:
            value["enum"] = [*value["enum"], None]
    names = {"prediction": value, **({"reasoning": {"type": "string"}} if reasoning else {})}
    return {"type": "object", "properties": names, "required": list(names), "additionalProperties": False}


def label_schema(labels: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """What clients are shown: labels with their options in the order of order_index, those without one last."""
    last = float("inf")
    place = lambda x: (last if x.get("order_index") is None else x["order_index"])
    rows = [{**{k: x.get(k) for k in ("label_id", "name", "type", "required", "na_allowed", "gating_expr")}, "options": [o.get("value") for o in sorted(x.get("options") or (), key=place)]} for x in sorted(labels, key=place)]
    return rows


def overlaid(labels: Mapping[str, Mapping[str, Any]], keywords: Mapping[str, Sequence[str]], queries: Mapping[str, str]) -> dict[str, dict[str, Any]]:
    """Label configurations with keywords and queries laid on; labels that only these name are left out."""
    return {k: {**v, **({"keywords": list(keywords[k])} if keywords.get(k) else {}), **({"search_query": queries[k]} if queries.get(k) else {})} for k, v in labels.items()}


def wants_reasoning(label: Mapping[str, Any], settings: Mapping[str, Any]) -> bool:
    """The label's own flag, else the settings' map for it, else the settings' flag."""
    for v in (label.get("reasoning"), (settings.get("reasoning_by_label") or {}).get(label.get("label_id")), settings.get("reasoning")):
        if v is not None:
            return str(v).strip().lower() in ("1", "true", "yes", "on")
    return False


def name_key(name: str) -> str:
    """A name for comparisons: blanks as one space, case folded."""
    return re.sub(r"\s+", " ", name).strip().casefold()


def unquoted(x: str) -> Any:
    """The value of a literal in a gating expression: a number, a quoted text, or the text itself."""
    try:
        return ast.literal_eval(x.strip())
    except (ValueError, SyntaxError):
        return x.strip()


def hms(seconds: float) -> str:
    s = int(max(0, seconds))
    return f"{s // 3600}:{s // 60 % 60:02}:{s % 60:02}"


def eta(done: int, total: int, seconds: float) -> str:
    """Time left at the pace so far; ? before the first one is done."""
    return hms(seconds / done * (total - done)) if done else "?"


def repaired_json(text: str | None) -> Any:
    """The first JSON object in a model's answer: code fences, text around it, single quotes, comments after commas and missing closing brackets are forgiven. None where there is none."""
    s = re.sub(r"```(?:json)?", "", text or "").strip()
    at = s.find("{")
    if at < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(s[at:])[0]
    except ValueError:
        pass
    depth, end, quote, esc, open_ = 0, None, "", False, []
    for i, c in enumerate(s[at:], at):
        if quote:
            esc = c == "\\" and not esc
            if c == quote and not esc and s[i - 1] != "\\":
                quote = ""
        elif c == '"':
            quote = c
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
            depth += 1
        elif c in "}]" and open_:
            open_.pop()
            depth -= 1
            if not depth:
                end = i + 1
                break
    body = s[at:end] if end else s[at:] + quote + "".join(reversed(open_))
    body = re.sub(r",\s*([}\]])", r"\1", body)
    for attempt in (json.loads, lambda x: json.loads(re.sub(r"(?<=[{,:\[\s])'([^']*)'(?=\s*[,:}\]])", r'"\1"', x)), ast.literal_eval):
        try:
            got = attempt(body)
            return got if isinstance(got, dict) else None
        except (ValueError, SyntaxError):
            continue
    return None
