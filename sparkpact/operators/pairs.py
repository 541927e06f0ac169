"""Queries and paths as tables: lexing, claims and segments in JVM expressions and joins.

The whole decoder (plans.wire) is one function a row; these are its relational steps, for
profiling many URLs at once. Owner tables have a row for each name that a contract
declares, so their size is the contract's and they are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.wire import PathDecoder, QueryDecoder


def raw_query(url: Column) -> Column:
    """What stands between the first ? and the fragment; '' if there is no query."""
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def raw_path(url: Column) -> Column:
    """The escaped path of an absolute URL."""
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _times(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def unescaped(raw: Column, plus: bool) -> Column:
    """Percent-decoded text; null if an escape is malformed or the result is not UTF-8."""
    text = F.try_url_decode(raw if plus else F.replace(raw, F.lit("+"), F.lit("%2B")))
    # decoding puts a U+FFFD for whatever is not UTF-8, so there are more of them than were spelled
    lossy = _times(text, "\ufffd") > _times(F.upper(raw), "%EF%BF%BD") + _times(raw, "\ufffd")
    return F.when(raw.rlike("%(?![0-9A-Fa-f]{2})") | lossy, F.lit(None)).otherwise(text)


def query_pairs(df: DataFrame, raw: Column, keys: list[str]) -> DataFrame:
    """keys, pos, raw_name, name, raw_value, value: the pairs of a raw query; an empty query has none."""
    parts = df.select(*keys, F.posexplode(F.split(F.when(raw != "", raw), "&")).alias("pos", "_part"))
    at = F.instr("_part", "=")
    name = F.when(at > 0, F.substring("_part", F.lit(1), at - 1)).otherwise(F.col("_part"))
    value = F.when(at > 0, F.substring("_part", at + 1, F.length("_part"))).otherwise(F.lit(""))
    parts = parts.select(*keys, "pos", name.alias("raw_name"), value.alias("raw_value"))
    return parts.select(*keys, "pos", "raw_name", unescaped(F.col("raw_name"), True).alias("name"), "raw_value", unescaped(F.col("raw_value"), True).alias("value"))


def bad_brackets(raw_name: Column) -> Column:
    return raw_name.rlike(r"[\[\]]")


def owner_table(df: DataFrame, decoder: QueryDecoder) -> DataFrame:
    """name, parameter, property: the exact names that a contract claims."""
    rows = [(n, decoder.wires[i].name, p) for n, (i, p) in decoder.owners.items()]
    return df.sparkSession.createDataFrame(rows, "name string, parameter string, property string")


def claims(pairs: DataFrame, decoder: QueryDecoder) -> DataFrame:
    """pairs with parameter and property: exact owner, then deepObject prefix, then the open form; null if passed over."""
    found = pairs.join(F.broadcast(owner_table(pairs, decoder)), "name", "left")
    deep_name, deep_child = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(decoder.deep):
        w = decoder.wires[i]
        m = rf"\A{re.escape(w.name)}\[([^\[\]]*)\]\z"
        hit = F.col("name").rlike(m) & F.lit(bool(w.dynamic))
        deep_name = F.when(hit, F.lit(w.name)).otherwise(deep_name)
        deep_child = F.when(hit, F.regexp_extract("name", m, 1)).otherwise(deep_child)
    open_name = F.lit(decoder.wires[decoder.open].name if decoder.open is not None else None).cast("string")
    exact = F.col("parameter").isNotNull()
    parameter = F.coalesce("parameter", deep_name, open_name)
    child = F.when(exact, F.col("property")).otherwise(F.coalesce(deep_child, F.when(open_name.isNotNull(), F.col("name"))))
    return found.withColumns({"parameter": parameter, "property": child})


def with_defaults(df: DataFrame, claimed: DataFrame, decoder: QueryDecoder, keys: list[str]) -> DataFrame:
    """keys and a column for each primitive parameter: its first value, its default, or null."""
    names = [w for w in decoder.wires if w.kind == "primitive"]
    first = claimed.filter(F.col("parameter").isin([w.name for w in names])).groupBy(*keys).agg(
        *[F.min_by(F.when(F.col("parameter") == w.name, F.col("value")), F.when(F.col("parameter") == w.name, F.col("pos"))).alias(w.name) for w in names]
    )
    out = df.select(*keys).join(first, keys, "left")
    return out.select(*keys, *[F.coalesce(w.name, F.lit(_text(w.default) if w.has_default else None)).alias(w.name) for w in names])


def _text(default: object) -> str | None:
    return None if default is None else default if isinstance(default, str) else getattr(default, "lexeme", str(default).lower())


def path_segments(df: DataFrame, path: Column, keys: list[str]) -> DataFrame:
    """keys, pos, segment."""
    return df.select(*keys, F.posexplode(F.split(path, "/")).alias("pos", "segment"))


def path_captures(path: Column, decoder: PathDecoder) -> dict[str, Column]:
    """The decoded text of each parameter; null where the path doesn't fit the template."""
    parts = F.split(path, "/")
    fits = F.size(parts) == len(decoder.segments)
    out: dict[str, Column] = {}
    names = iter(w.name for w in decoder.wires)
    for i, expression in enumerate(decoder.segments):
        whole = rf"\A(?:{expression.pattern})\z"
        part = F.get(parts, F.lit(i))
        fits = fits & part.rlike(whole)
        for g in range(expression.groups):
            out[next(names)] = unescaped(F.regexp_extract(part, whole, g + 1), False)
    return {n: F.when(fits, c) for n, c in out.items()}
