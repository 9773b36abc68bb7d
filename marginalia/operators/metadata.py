"""Metadata: typed filters, discovery of fields and their types, and fields that don't vary within a patient."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


@dataclass
class Condition:
    """A field's allowed values, or its range with both ends in it."""

    field: str
    type: str = "text"
    values: Sequence[str] = field(default_factory=tuple)
    min: str | None = None
    max: str | None = None

    @classmethod
    def of(cls, d: dict) -> Condition:
        """From a config entry; min_value and max_value are read as min and max."""
        return cls(d["field"], d.get("type", "text"), tuple(d.get("values") or ()), d.get("min", d.get("min_value")), d.get("max", d.get("max_value")))

    def to_dict(self) -> dict:
        """A config entry that of() reads back; what isn't set is left out."""
        out = {"field": self.field, "type": self.type}
        return out | ({"values": list(self.values)} if self.values else {}) | {k: v for k, v in (("min", self.min), ("max", self.max)) if v is not None}

    def column(self) -> Column:
        c = F.col(self.field)
        if self.type in ("number", "numeric"):
            read = lambda x: dates.parse_number(x)
        elif self.type == "date":
            read = lambda x: dates.parse_date(x)
        else:
            read = lambda x: x.cast("string")
        tests = []
        if self.values:
            tests.append(read(c).isin(*[read(F.lit(v)) for v in self.values]))
        if self.min is not None:
            tests.append(read(c) >= read(F.lit(str(self.min))))
        if self.max is not None:
            tests.append(read(c) <= read(F.lit(str(self.max))))
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def conditions_of(config: Sequence[dict] | dict | None, known: Sequence[str]) -> tuple[list[Condition], bool]:
    """(conditions, whether any suffices) of a config: a list, or {logic: and | or, conditions: [...]}. A field that isn't known raises."""
    logic, entries = (config.get("logic", "and"), config.get("conditions") or ()) if isinstance(config, dict) else ("and", config or ())
    found = [Condition.of(e) for e in entries]
    if gone := [c.field for c in found if c.field not in known]:
        raise ValueError(f"unknown metadata fields: {gone}")
    if str(logic).lower() not in ("and", "or", "all", "any"):
        raise ValueError(f"unknown logic: {logic}")
    return found, str(logic).lower() in ("or", "any")


def metadata_filter(rows: DataFrame, conditions: Sequence[Condition], *, match_any: bool = False) -> DataFrame:
    """Rows that meet all conditions, or any. An unknown field raises. Text and date columns compare in the scan."""
    missing = [c.field for c in conditions if c.field not in rows.columns]
    if missing:
        raise ValueError(f"unknown metadata fields: {missing}")
    if not conditions:
        return rows
    tests = [c.column() for c in conditions]
    return rows.where(reduce((lambda a, b: a | b) if match_any else (lambda a, b: a & b), tests))


def regex_filter(rows: DataFrame, pattern: str, column: str = "text", *, ignore_case: bool = True) -> DataFrame:
    return rows.where(F.col(column).rlike(("(?i)" if ignore_case else "") + pattern))


def discover(rows: DataFrame, meta: str) -> DataFrame:
    """(field, type, n_values, n_distinct): each key of a map column whose values aren't all blank: number, date or text, by all of its values."""
    e = rows.select(F.explode(meta).alias("field", "v")).withColumn("v", F.trim("v")).where("v is not null and v <> ''")
    per = e.groupBy("field").agg(F.min(dates.parse_number(F.col("v")).isNotNull()).alias("num"), F.min(dates.parse_date(F.col("v")).isNotNull()).alias("day"), F.count("*").alias("n_values"), F.count_distinct("v").alias("n_distinct"))
    return per.select("field", F.when(F.col("num"), "number").when(F.col("day"), "date").otherwise("text").alias("type"), "n_values", "n_distinct")


def constant_within(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, constant): whether a field has one value, null or not, within each key."""
    per = rows.groupBy(key).agg(*[(F.coalesce(F.min(f) == F.max(f), F.lit(True)) & ((F.count(f) == 0) | (F.count(f) == F.count("*")))).alias(f) for f in fields])
    one = per.agg(*[F.coalesce(F.min(f), F.lit(True)).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("constant")) for f in fields])).alias("x")).select("x.*")


def cleaned(meta: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(meta, lambda k, v: text.nonblank(v).isNotNull())


def merged(*maps: Column) -> Column:
    """Maps in falling precedence as one."""
    pairs = reduce(lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(a), k))), maps)
    return pairs


def sorted_json(meta: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta))))
