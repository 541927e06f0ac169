"""Schemas on typed tables: each rule is one JVM expression, so a scan checks all of them.

A row is an object and a column a property. A null column is an absent property (so
`required` speaks, `type` does not), or with null_as='null' a JSON null. Numbers are
compared exactly (see operators.numeric); doubles stand for the shortest text that names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import Num, escape_token
from ..functions.formats import format_column
from ..plans.schema import Schema
from .numeric import Number


@dataclass
class Rule:
    """A violated rule is one whose test is true."""

    pointer: Column
    schema_pointer: str
    keyword: str
    broken: Column


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "number" if isinstance(t, T.NumericType) else "string"


def _count(n: Num) -> int:
    """A count's bound, as far as a count can reach."""
    return min(int(n.digits) * 10 ** min(n.exp, 19), 2**62)


def rules(s: Schema, value: Column, kind: T.DataType, at: Column, null_as: str) -> list[Rule]:
    """All rules for a value that a column holds. Rules of absent values never break."""
    out: list[Rule] = []
    there = value.isNotNull()

    def add(keyword: str, broken: Column, pointer: Column = at, base: Column | None = there) -> None:
        test = broken if base is None else base & broken
        out.append(Rule(pointer, s.pointer, keyword, F.coalesce(test, F.lit(False))))

    own = _kind(kind)
    x = Number(value, kind) if own == "number" else None
    if s.type:
        if own == "number" and s.type in ("integer", "number"):
            if s.type == "integer" and not isinstance(kind, T.IntegralType):
                add("type", ~x.finite | ~x.is_integer())
            elif x.binary:
                add("type", ~x.finite)
        elif own != s.type:
            add("type", F.lit(True))
        if null_as == "null" and not s.nullable:
            add("type", value.isNull(), base=None)
    if s.enum:
        allowed = [v for v in s.enum if _same_kind(v, own)]
        if not allowed:
            add("enum", F.lit(True))
        elif own == "number":
            add("enum", ~_any([x.equals(v) for v in allowed]))
        elif own in ("string", "boolean"):
            add("enum", ~value.isin(allowed))
        if null_as == "null" and not any(v is None for v in s.enum):
            add("enum", value.isNull(), base=None)
    if own == "number":
        # what is no JSON number breaks no rule of numbers
        number = lambda keyword, broken: add(keyword, x.finite & broken if x.binary else broken)
        if s.minimum is not None:
            number("exclusiveMinimum" if s.exclusive_minimum else "minimum", x.below(s.minimum, s.exclusive_minimum))
        if s.maximum is not None:
            number("exclusiveMaximum" if s.exclusive_maximum else "maximum", x.above(s.maximum, s.exclusive_maximum))
        if s.multiple_of is not None:
            number("multipleOf", ~x.is_multiple_of(s.multiple_of))
        if s.number_format in ("int32", "int64"):
            edge = 2 ** (int(s.number_format[3:]) - 1)
            number("format", ~x.is_integer() | x.below(Num.of(-edge), False) | x.above(Num.of(edge - 1), False))
        elif s.number_format == "float":
            number("format", x.below(Num.of(-(2**128 - 2**103)), True) | x.above(Num.of(2**128 - 2**103), True))
        elif s.number_format == "double":
            number("format", F.lit(False))  # a finite column has no number beyond a double
    elif own == "string":
        text = value.cast("string")
        if s.min_length is not None:
            add("minLength", F.char_length(text) < _count(s.min_length))
        if s.max_length is not None:
            add("maxLength", F.char_length(text) > _count(s.max_length))
        if s.pattern is not None:
            add("pattern", ~s.pattern.column(text))
        if s.string_format:
            add("format", ~format_column(s.string_format, text))
    elif own == "array":
        if s.min_items is not None:
            add("minItems", F.size(value) < _count(s.min_items))
        if s.max_items is not None:
            add("maxItems", F.size(value) > _count(s.max_items))
    elif isinstance(kind, T.StructType):
        out += object_rules(s, {f.name: (value[f.name], f.dataType) for f in kind.fields}, at, null_as, there)
    for c in s.all_of:
        out += rules(c, value, kind, at, null_as)
    if s.any_of:
        branches = [rules(c, value, kind, at, null_as) for c in s.any_of]
        add("anyOf", _all_fail(branches))
    return out


def _same_kind(v: object, own: str) -> bool:
    return {"number": isinstance(v, Num), "string": isinstance(v, str), "boolean": isinstance(v, bool)}.get(own, False)


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _all_fail(branches: list[list[Rule]]) -> Column:
    found = F.lit(True)
    for b in branches:
        broken = F.lit(False)
        for r in b:
            broken = broken | r.broken
        found = found & broken
    return found


def object_rules(s: Schema, columns: dict[str, tuple[Column, T.DataType]], at: Column, null_as: str, base: Column | None = None) -> list[Rule]:
    """The rules of an object whose members are columns."""
    out: list[Rule] = []

    def here(name: str) -> Column:
        return F.concat(at, F.lit("/" + escape_token(name)))

    def add(keyword: str, broken: Column, pointer: Column) -> None:
        out.append(Rule(pointer, s.pointer, keyword, broken if base is None else base & broken))

    absent = (lambda c: c.isNull()) if null_as == "absent" else (lambda c: F.lit(False))
    n = F.lit(0)
    for c, _ in columns.values():
        n = n + F.when(absent(c), 0).otherwise(1)
    if s.min_properties is not None:
        add("minProperties", n < _count(s.min_properties), at)
    if s.max_properties is not None:
        add("maxProperties", n > _count(s.max_properties), at)
    for name in s.required:
        add("required", absent(columns[name][0]) if name in columns else F.lit(True), here(name))
    for name in sorted(columns, key=str.encode):
        c, kind = columns[name]
        child = s.properties.get(name, s.additional)
        if child is not None:
            out += rules(child, c, kind, here(name), null_as)
        elif s.closed:
            add("additionalProperties", ~absent(c), here(name))
    for c in s.all_of:
        out += object_rules(c, columns, at, null_as, base)
    if s.any_of:
        add("anyOf", _all_fail([object_rules(c, columns, at, null_as, base) for c in s.any_of]), at)
    return out


def array_items(df: DataFrame, column: str, s: Schema, keys: list[str]) -> DataFrame:
    """keys, idx and keyword of each element of an array column that breaks a rule of s.items."""
    kind = df.schema[column].dataType.elementType
    each = df.select(*keys, F.posexplode(column).alias("idx", "_item"))
    # elements of a null array don't exist; a null element is a JSON null
    return _broken(each, rules(s.items, F.col("_item"), kind, F.lit("#"), "null"), [*keys, "idx"])


def _broken(df: DataFrame, found: list[Rule], keys: list[str]) -> DataFrame:
    """A row for each broken rule: keys, pointer, schema_pointer, keyword."""
    listed = F.array(
        *[F.when(r.broken, F.struct(r.pointer.alias("pointer"), F.lit(r.schema_pointer).alias("schema_pointer"), F.lit(r.keyword).alias("keyword"))) for r in found]
    )
    return df.select(*keys, F.inline(F.filter(listed, lambda x: x.isNotNull())))


def table_rules(df: DataFrame, s: Schema, columns: list[str] | None = None, null_as: str = "absent") -> list[Rule]:
    use = columns if columns is not None else [n for n in df.columns if n in _named(s)] if not s.closed else df.columns
    return object_rules(s, {n: (df[n], df.schema[n].dataType) for n in use}, F.lit("#"), null_as)


def _named(s: Schema) -> set[str]:
    return {*s.properties, *s.required, *(n for c in [*s.all_of, *s.any_of] for n in _named(c))}


def table_violations(df: DataFrame, s: Schema, keys: list[str], columns: list[str] | None = None, null_as: str = "absent") -> DataFrame:
    """keys, pointer, schema_pointer, keyword: a row for each broken rule of each row.

    columns: those that make up the object; as a rule those that the schema names, or
    all if it is closed. Only they and the keys are read.
    """
    return _broken(df, table_rules(df, s, columns, null_as), keys)


def violation_counts(df: DataFrame, s: Schema, columns: list[str] | None = None, null_as: str = "absent") -> DataFrame:
    """pointer, keyword, violations: how many rows break each rule; one aggregation without a key, one row a task."""
    found = table_rules(df, s, columns, null_as)
    sums = df.agg(*[F.count_if(r.broken).alias(f"_{i}") for i, r in enumerate(found)])
    each = F.array(*[F.struct(r.pointer.alias("pointer"), F.lit(r.keyword).alias("keyword"), F.col(f"_{i}").alias("violations")) for i, r in enumerate(found)])
    return sums.select(F.inline(each))


def is_valid(df: DataFrame, s: Schema, columns: list[str] | None = None, null_as: str = "absent") -> Column:
    broken = F.lit(False)
    for r in table_rules(df, s, columns, null_as):
        broken = broken | r.broken
    return ~broken
