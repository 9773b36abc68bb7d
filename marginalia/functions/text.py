"""Text expressions: canonical notes, tokens, yes/no values and multi-select values. All run in the JVM but nfkc()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

YES = ("yes", "y", "true", "1", "present", "positive", "pos", "t")
NO = ("no", "n", "false", "0", "absent", "negative", "neg", "f")
UNKNOWN = ("unknown", "unk", "n/a", "na", "uncertain", "not sure", "indeterminate")
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "with")


def canonical_note(text: Column) -> Column:
    """Line ends as \\n, and no blanks at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)[^\S\n]+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_note(text), 256)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nonblank(text: Column) -> Column:
    """Trimmed text, null for a blank one or the tokens nan and none."""
    t = F.trim(text.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def note_year(text: Column) -> Column:
    """The first four digits in a row as an integer."""
    return F.regexp_extract(text.cast("string"), r"(\d{4})", 1).try_cast("int")


def yes_no(value: Column) -> Column:
    """yes, no or unknown for the usual spellings; other values in lower case; null for a blank one."""
    v = F.lower(collapsed(value.cast("string")))
    return F.when(v.isin(*YES), "yes").when(v.isin(*NO), "no").when(v.isin(*UNKNOWN), "unknown").when(v != "", v)


def multi_tokens(value: Column) -> Column:
    """The trimmed, non-empty parts between commas, semicolons and line ends; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;\n]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def multi_set(value: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(multi_tokens(value), F.lower)))


def chosen(value: Column, kind: str) -> Column:
    """Options that a multi-select value names, in the order they stand and comma-joined: of a text its tokens, of a list its items, of a map the keys whose value is true."""
    if kind == "map":
        items = F.map_keys(F.map_filter(value, lambda k, v: F.coalesce(v.cast("boolean"), F.lit(False))))
    else:
        items = multi_tokens(value) if kind == "string" else value
    clean = F.filter(F.transform(items, lambda x: F.trim(x.cast("string"))), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_join(F.array_distinct(clean), ",")


def in_option_order(value: Column, options: list[str]) -> Column:
    """The given options that the value names, comma-joined in the order of the options."""
    have = multi_set(value)
    opts = F.array(*[F.lit(o) for o in options])
    return F.array_join(F.filter(opts, lambda o: F.array_contains(have, F.lower(o))), ",")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


#: Characters that NFKC changes: compatibility forms and combining marks.
COMPATIBLE = r"[\u00a0\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be\u0132\u0133\u013f\u0140\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u02b0-\u02b8\u02d8-\u02dd\u02e0-\u02e4\u0300-\u036f\u0374-\u0387\u03d0-\u03d6\u03f0-\u03f9\u1100-\u11ff\u1d2c-\u1d78\u1d9b-\u1dbf\u1e9a\u1e9b\u1fbd-\u1fc1\u2000-\u200a\u2011\u2017\u2024-\u2026\u202f-\u2037\u203c\u203e\u2047-\u2049\u2057\u205f\u2070-\u209c\u20a8\u2100-\u218b\u222c-\u2230\u2460-\u24ff\u2a74-\u2a76\u2c7c\u2c7d\u3000-\u33ff\ua69c-\ua770\uf900-\ufaff\ufb00-\uffef\x{1d400}-\x{1d7ff}\x{1f100}-\x{1f251}]"


#: All of these and more: what a quick look finds beyond ASCII and the letters of Latin-1.
UNUSUAL = r"[^\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff]"


def search_tokens(text: Column) -> Column:
    """Tokens of keyword search: the text in NFKC, lower-cased, in runs of a-z, digits and _ + - /, without stop words. Only texts that NFKC may change go to Python."""
    whole = F.coalesce(nfkc(F.when(text.rlike(UNUSUAL) & text.rlike(COMPATIBLE), text)), text)
    return plain_tokens(whole)


def plain_tokens(text: Column) -> Column:
    """search_tokens of a text that is in NFKC."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_+\-/]+)"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*STOP_WORDS))


def stable_hash_rules(rules: Column) -> Column:
    """A hash of a map of rules that doesn't depend on its order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rules)))), 256)


def json_value(value: Column, kind: str) -> Column:
    """A value as JSON can hold it: NaN and infinite numbers as null, dates and times in ISO form."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else value


def json_safe(df: DataFrame) -> DataFrame:
    """df with json_value() of every column, and nested columns as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(*[(F.to_json(f.name) if f.dataType.typeName() in nested else json_value(F.col(f.name), f.dataType.typeName())).alias(f.name) for f in df.schema.fields])


def json_like(text: Column, schema: str) -> Column:
    """What JSON text holds, by a schema; texts in which Python quotes its values are read too; null for anything else or blank."""
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\bNone\\b", "null"), "\\bTrue\\b", "true"), "\\bFalse\\b", "false"), "'", '"')
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(ok(F.trim(text)), ok(F.trim(python)))


def loose_bool(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "true", "t", "yes", "y", "on"), True).when(v.isin("0", "false", "f", "no", "n", "off", ""), False)


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts one after the other."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sanitised(name: str) -> str:
    """A column alias: runs of other characters than letters, digits and _ as _, f_ before a digit."""
    import re

    s = re.sub(r"[^0-9A-Za-z_]+", "_", name)
    return f"f_{s}" if s[:1].isdigit() else s


LABEL_TYPES = {
    "binary": ("boolean", "bool", "yes-no", "yes/no", "yesno", "binary"),
    "categorical_multi": ("multi_select", "multiselect", "multi", "categorical_multi"),
    "numeric": ("numeric", "number", "float", "integer", "int", "double"),
    "date": ("date", "datetime", "timestamp"),
    "ordinal": ("ordinal",),
}


def label_type(name: Column) -> Column:
    """The label type that an alias stands for; categorical for any other."""
    n = F.lower(F.trim(name))
    out = F.lit("categorical")
    for kind, aliases in LABEL_TYPES.items():
        out = F.when(n.isin(*aliases), kind).otherwise(out)
    return out
