"""Comparing data contracts: the fields and relations of a database model against those of an interface type.

fields(pair, side 'orm'|'ts', raw_name, type_json, nullable, line, seq), relations(pair, side, raw_name, cardinality,
line, seq); config(pair, ignore_orm, ignore_ts, field_aliases array<struct<orm,ts>>, relation_aliases).
Types are canonical JSON: {"kind":"primitive","value":"string"} and so on, arrays and unions nested.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.functions.text import snake_to_camel

#: The order of violations on one line.
RANKS = ("FieldMissingOnTs", "FieldMissingOnOrm", "NullabilityMismatch", "TypeMismatch", "UnmappedOrmType", "RelationMissingOnTs", "RelationMissingOnOrm", "CardinalityMismatch")


def types_match(a: dict, b: dict) -> bool:
    """Structural equality; an unknown primitive matches anything, unions match position by position."""
    unknown = {"kind": "primitive", "value": "unknown"}
    if a == unknown or b == unknown:
        return True
    if a.get("kind") != b.get("kind"):
        return False
    x, y = a.get("value"), b.get("value")
    if a["kind"] == "array":
        return types_match(x, y)
    if a["kind"] == "union":
        return len(x) == len(y) and all(map(types_match, x, y))
    return x == y


@F.pandas_udf(T.BooleanType())
def types_match_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([types_match(json.loads(a), json.loads(b)) for a, b in zip(left, right, strict=True)], dtype=bool)


def _key(side: str, aliases: str, case_rule: str) -> Column:
    """The name both sides meet under: an alias, else the raw name by the case rule."""
    hit = F.filter(F.coalesce(F.col(aliases), F.array()), lambda a: a[side] == F.col("raw_name"))
    plain = snake_to_camel(F.col("raw_name")) if case_rule == "snake_camel" else F.col("raw_name")
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["ts"]).otherwise(plain)


def _aligned(table: DataFrame, config: DataFrame, side: str, aliases: str, case_rule: str, columns: list[str], ignore: str | None) -> DataFrame:
    """One row for each key of a side; of two rows with one key the last counts."""
    rows = table.filter(F.col("side") == side).join(F.broadcast(config) if config.limit(10_001).count() <= 10_000 else config, "pair", "left")
    if ignore:
        rows = rows.filter(~F.array_contains(F.coalesce(F.col(ignore), F.array().cast("array<string>")), F.col("raw_name")))
    last = rows.withColumn("key", _key(side, aliases, case_rule)).groupBy("pair", "key").agg(F.max_by(F.struct(*columns), "seq").alias(side))
    return last


def compare(fields: DataFrame, relations: DataFrame, config: DataFrame, case_rule: str = "snake_camel", overrides: dict[str, str] | None = None, unmapped_severity: str = "warning") -> DataFrame:
    """(pair, line, rank, violation, name, severity), one row a violation; order by line, rank and name.

    `overrides`: canonical JSON types for database types that have no mapping of their own.
    """
    columns = ["type_json", "nullable", "line"]
    both = _aligned(fields, config, "orm", "field_aliases", case_rule, columns, "ignore_orm").join(_aligned(fields, config, "ts", "field_aliases", case_rule, columns, "ignore_ts"), ["pair", "key"], "full_outer")
    raw = F.get_json_object("orm.type_json", "$.value")
    unmapped = F.get_json_object("orm.type_json", "$.kind") == "unmapped"
    resolved = F.col("orm.type_json")
    for name, kind in (overrides or {}).items():
        resolved = F.when(unmapped & (raw == name), F.lit(kind)).otherwise(resolved)
    both = both.withColumn("resolved", resolved)
    shared = F.col("orm").isNotNull() & F.col("ts").isNotNull()
    still = F.get_json_object("resolved", "$.kind") == "unmapped"
    equal = (F.col("resolved") == F.col("ts.type_json")) | types_match_udf(F.coalesce("resolved", F.lit("{}")), F.coalesce("ts.type_json", F.lit("{}")))

    def hit(test: Column, kind: str, line: Column) -> Column:
        return F.when(test, F.struct(line.alias("line"), F.lit(RANKS.index(kind)).alias("rank"), F.lit(kind).alias("violation")))

    found = both.withColumn("equal", equal).select("pair", "key", F.explode(F.array_compact(F.array(
        hit(F.col("ts").isNull(), "FieldMissingOnTs", F.col("orm.line")),
        hit(F.col("orm").isNull(), "FieldMissingOnOrm", F.col("ts.line")),
        hit(shared & (F.col("orm.nullable") != F.col("ts.nullable")), "NullabilityMismatch", F.col("orm.line")),
        hit(shared & ~still & ~F.col("equal"), "TypeMismatch", F.col("orm.line")),
        hit(shared & still, "UnmappedOrmType", F.col("orm.line")),
    ))).alias("v"))
    columns = ["cardinality", "line"]
    ends = _aligned(relations, config, "orm", "relation_aliases", case_rule, columns, None).join(_aligned(relations, config, "ts", "relation_aliases", case_rule, columns, None), ["pair", "key"], "full_outer")
    shared = F.col("orm").isNotNull() & F.col("ts").isNotNull()
    more = ends.select("pair", "key", F.explode(F.array_compact(F.array(
        hit(F.col("ts").isNull(), "RelationMissingOnTs", F.col("orm.line")),
        hit(F.col("orm").isNull(), "RelationMissingOnOrm", F.col("ts.line")),
        hit(shared & (F.col("orm.cardinality") != F.col("ts.cardinality")), "CardinalityMismatch", F.col("orm.line")),
    ))).alias("v"))
    out = found.unionByName(more).select("pair", "v.line", "v.rank", "v.violation", F.col("key").alias("name"))
    return out.withColumn("severity", F.when(F.col("violation") == "UnmappedOrmType", F.lit(unmapped_severity)).otherwise("error"))


def summary(violations: DataFrame) -> DataFrame:
    """(pair, errors, warnings)."""
    return violations.groupBy("pair").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
