import dataclasses

import pytest

from marginalia.operators import config as C


@dataclasses.dataclass
class Inner:
    k: int = 1
    names: dict = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Outer:
    inner: Inner = dataclasses.field(default_factory=Inner)
    n: int = 3


def test_overrides_are_merged_level_by_level():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    got = C.deep_merged(base, {"a": {"b": 5}, "e": {"f": 1}})
    assert got == {"a": {"b": 5, "c": [1]}, "d": 2, "e": {"f": 1}} and base["a"]["b"] == 1
    o = C.deep_merged(Outer(), {"inner": {"k": 7}})
    assert o.inner.k == 7 and o.n == 3
    with pytest.raises(ValueError):
        C.deep_merged(Outer(), {"other": 1})
    assert C.normal_overrides({"rag": {"per_label_topk": 4}, "llm": {"model_dir": " /m/x/ "}}) == {"rag": {"top_k_final": 4}, "llm": {"model_dir": "/m/x"}}
    assert C.normal_overrides({"per_label_topk": 4, "top_k_final": 9}) == {"top_k_final": 9}
    assert C.shares_backend({"llm": {"model": "a", "temperature": 1}}, {"llm": {"model": "a"}, "n": 3}) and not C.shares_backend({"llm": {"model": "a"}}, {"llm": {"model": "b"}})


def test_hashes_do_not_depend_on_order():
    assert C.config_hash({"a": 1, "b": [1, 2]}) == C.config_hash({"b": [1, 2], "a": 1}) != C.config_hash({"a": 1, "b": [2, 1]})
    assert C.canonical_json({"b": "é", "a": None}) == '{"a":null,"b":"é"}'


def test_rules_options_keywords():
    assert C.rules_of({"rules": ["old", "", "new "], "why": "x"}) == "new" and C.rules_of({"rule": " ", "text": "t"}) == "t" and C.rules_of({}) == ""
    assert C.rules_of({"rules": [{"text": "a"}, {"rule": "b"}]}) == "b"
    assert C.options_of({"options": [{"value": "a"}, "b", "a", None]}) == ["a", "b"] and C.options_of({"type": "binary"}) == ["yes", "no"]
    assert C.options_of({"options": ["x"]}, most=26) == [] and len(C.options_of({"options": list(range(26))}, most=26)) == 26 and C.options_of({"options": list(range(27))}, most=26) == []
    assert C.keywords_of("q", {"keywords": ["c", "A"]}, {"keywords": ["a"], "label_keywords": {"q": ["b", " "]}}) == ["a", "b", "c"]


def test_query_choice_and_exemplars():
    label = {"name": "L", "options": list("abcdefgh"), "rules": "the rule"}
    assert C.search_queries(label | {"rag_query": "by hand"}, exemplars=["x"]) == ("manual", ["by hand"])
    assert C.search_queries(label, exemplars=[str(i) for i in range(20)]) == ("exemplars", [str(i) for i in range(8)])
    assert C.search_queries(label) == ("rules", ["the rule"]) and C.search_queries({}) == ("rules", [])
    got = C.exemplars_of(label, 6, lambda r, o, n: [f"{o}{i}" for i in range(n)])
    assert got == [f"{o}0" for o in "abcdefgh"]
    assert C.exemplars_of({"name": "L", "options": ["a", "b"], "rules": "r"}) == ["L a r", "L b r"]
    assert C.exemplars_of({"options": ["a", "b"]}, 4, lambda r, o, n: [f"{o}{i}" for i in range(n)]) == ["a0", "b0", "a1", "b1", "a2", "b2"][:4]
    assert C.rerank_query("x" * 151, lambda s: "short") == "short" and C.rerank_query("x" * 150, lambda s: "short") == "x" * 150 and C.rerank_query("x" * 200, lambda s: "") == "x" * 200


def test_messages_and_schemas():
    assert C.few_shot([{"context": "c", "answer": {"b": 1, "a": 2}}, {"text": "t", "answer": " yes "}, {"context": "no answer"}]) == [
        {"role": "user", "content": "c"},
        {"role": "assistant", "content": '{"a":2,"b":1}'},
        {"role": "user", "content": "t"},
        {"role": "assistant", "content": "yes"},
    ]
    s = C.response_schema({"type": "categorical", "options": ["a", "b"], "na_allowed": True}, reasoning=True)
    assert s["properties"]["prediction"] == {"type": ["string", "null"], "enum": ["a", "b", None]} and s["required"] == ["prediction", "reasoning"]
    assert C.response_schema({"type": "integer"})["properties"]["prediction"] == {"type": ["integer"]} and C.response_schema({"type": "categorical_multi"})["properties"]["prediction"]["type"] == ["array"]
    shown = C.label_schema([{"label_id": "b"}, {"label_id": "a", "order_index": 1, "options": [{"value": "y"}, {"value": "x", "order_index": 0}]}])
    assert [x["label_id"] for x in shown] == ["a", "b"] and shown[0]["options"] == ["x", "y"]
    assert C.overlaid({"a": {"t": 1}}, {"a": ["k"], "z": ["k"]}, {"a": "q"}) == {"a": {"t": 1, "keywords": ["k"], "search_query": "q"}}
    assert C.wants_reasoning({"label_id": "a", "reasoning": False}, {"reasoning": True}) is False and C.wants_reasoning({"label_id": "a"}, {"reasoning_by_label": {"a": "yes"}}) and not C.wants_reasoning({}, {})


def test_small_helpers():
    assert C.name_key("  Ä  b\tC ") == "ä b c" and C.unquoted("'x'") == "x" and C.unquoted(" 3 ") == 3 and C.unquoted("x y") == "x y"
    assert C.hms(3723.9) == "1:02:03" and C.eta(0, 5, 1) == "?" and C.eta(2, 6, 60) == "0:02:00"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure:\n```json\n{"a": [1, 2,], }\n``` bye', {"a": [1, 2]}),
        ("{'prediction': 'yes', 'x': None}", {"prediction": "yes", "x": None}),
        ('{"a": {"b": "c"', {"a": {"b": "c"}}),
        ('{"a": "unclosed', {"a": "unclosed"}),
        ('x {"a": "has } brace"} y', {"a": "has } brace"}),
        ("no json", None),
        (None, None),
        ("[1]", None),
    ],
)
def test_repair(text, want):
    assert C.repaired_json(text) == want
