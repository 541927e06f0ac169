"""Documents as node tables, checked by joins with a rule table.

The same verdicts as operators.evaluate, with rules as data: a node table row for each
value, a rule table row for each keyword of each schema occurrence. Occurrences are
unrolled to the schema's depth, so one equi-join by the node's shape replaces recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import Num, escape_token
from ..plans.schema import Schema
from .columns import strict_nodes

RULES = (
    "template string, schema_pointer string, keyword string, child string, type string, nullable boolean, "
    "num_neg boolean, num_mag bigint, num_digits string, exclusive boolean, n bigint, members array<string>"
)


def node_table(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """keys and a row for each value of the JSON text; text that is not strict JSON has no rows."""
    parsed = df.select(*keys, strict_nodes(F.col(json_col)).alias("_s"))
    return parsed.select(*keys, F.inline("_s.nodes"))


def _bound(n: Num) -> int:
    return min(int(n.digits) * 10 ** min(n.exp, 19), 2**62)


def rule_rows(s: Schema, at: str = "#") -> list[tuple]:
    """A schema's rules, by instance template; '*' stands for an array's index or an undeclared name.

    allOf branches are rules at the same template. anyOf has no row: it is no conjunction.
    """
    out: list[tuple] = []

    def add(keyword: str, child: str | None = None, type: str | None = None, nullable: bool | None = None, bound: Num | None = None, exclusive: bool | None = None, n: int | None = None, members: list[str] | None = None) -> None:  # noqa: A002
        number = (bound.sign == "-", bound.mag, bound.digits) if bound is not None else (None, None, None)
        out.append((at, s.pointer, keyword, child, type, nullable, *number, exclusive, n, members))

    if s.type:
        add("type", type=s.type, nullable=s.nullable)
    if s.enum:
        add("enum", members=list(s.members))
    for word, bound, exclusive in (("minimum", s.minimum, s.exclusive_minimum), ("maximum", s.maximum, s.exclusive_maximum)):
        if bound is not None:
            add(word, bound=bound, exclusive=exclusive)
    for word, bound in (
        ("minLength", s.min_length), ("maxLength", s.max_length), ("minItems", s.min_items), ("maxItems", s.max_items),
        ("minProperties", s.min_properties), ("maxProperties", s.max_properties),
    ):
        if bound is not None:
            add(word, n=_bound(bound))
    for name in s.required:
        add("required", child=name)
    for name in s.properties:
        add("properties", child=name)
    if s.closed:
        add("additionalProperties", members=sorted(s.properties))
    if s.items is not None:
        out += rule_rows(s.items, f"{at}/*")
    for name, c in s.properties.items():
        out += rule_rows(c, f"{at}/{escape_token(name)}")
    for c in s.all_of:
        out += rule_rows(c, at)
    return out


def rule_table(spark: SparkSession, s: Schema) -> DataFrame:
    return spark.createDataFrame(rule_rows(s), RULES)


def _less(neg: Column, mag: Column, digits: Column, rneg: Column, rmag: Column, rdigits: Column) -> Column:
    """Whether a number lies below a bound, by sign, magnitude and digits."""
    zero, rzero = digits == "0", rdigits == "0"
    rank = F.when(zero, 0).when(neg, -1).otherwise(1)
    rrank = F.when(rzero, 0).when(rneg, -1).otherwise(1)
    below = F.struct(mag, digits) < F.struct(rmag, rdigits)
    above = F.struct(mag, digits) > F.struct(rmag, rdigits)
    return F.when(rank != rrank, rank < rrank).when(rank == 0, F.lit(False)).when(rank > 0, below).otherwise(above)


def violations(nodes: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pointer, schema_pointer, keyword: all failures of a node table, rules without patterns and formats.

    One broadcast join with the rules, of the contract's size; no shuffle. Members that are missing
    or undeclared are those by which an object's names and a rule's differ.
    """
    both = nodes.join(F.broadcast(rules.withColumnsRenamed({"num_neg": "rneg", "num_mag": "rmag", "num_digits": "rdigits"})), "template")
    number = F.col("kind") == "number"
    integer = number & (F.col("num_exp") >= 0)
    same = F.when(F.col("type") == "integer", integer).otherwise(F.col("kind") == F.col("type"))
    less = _less(*[F.col(c) for c in ("num_neg", "num_mag", "num_digits", "rneg", "rmag", "rdigits")])
    equal = (F.col("num_neg") == F.col("rneg")) & (F.col("num_mag") == F.col("rmag")) & (F.col("num_digits") == F.col("rdigits"))
    own = F.when(F.col("kind") == "string", _quoted(F.col("text"))).otherwise(F.col("text"))
    k = F.col("keyword")
    length = F.char_length("text")
    broken = (
        F.when(k == "type", ~same & ~((F.col("kind") == "null") & F.col("nullable")))
        .when(k == "enum", ~F.array_contains("members", own))
        .when(k == "minimum", number & (less | (equal & F.col("exclusive"))))
        .when(k == "maximum", number & ((~less & ~equal) | (equal & F.col("exclusive"))))
        .when(k == "minLength", (F.col("kind") == "string") & (length < F.col("n")))
        .when(k == "maxLength", (F.col("kind") == "string") & (length > F.col("n")))
        .when(k == "minItems", (F.col("kind") == "array") & (F.col("size") < F.col("n")))
        .when(k == "maxItems", (F.col("kind") == "array") & (F.col("size") > F.col("n")))
        .when(k == "minProperties", (F.col("kind") == "object") & (F.col("size") < F.col("n")))
        .when(k == "maxProperties", (F.col("kind") == "object") & (F.col("size") > F.col("n")))
        .otherwise(F.lit(False))
    )
    word = F.when((k == "minimum") & F.col("exclusive"), "exclusiveMinimum").when((k == "maximum") & F.col("exclusive"), "exclusiveMaximum").otherwise(k)
    below = lambda names: F.transform(names, lambda n: F.concat("pointer", F.lit("/"), _token(n)))
    is_object = F.col("kind") == "object"
    places = (
        F.when((k == "required") & is_object, below(F.array_except(F.array("child"), "names")))
        .when((k == "additionalProperties") & is_object, below(F.array_except("names", F.coalesce("members", F.array().cast("array<string>")))))
        .when(broken, F.array("pointer"))
    )
    return both.select(*keys, F.explode(places).alias("pointer"), "schema_pointer", word.alias("keyword"))


def _token(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_token(name: Column) -> Column:
    """A name as a JSON Pointer's token."""
    return _token(name)


def _quoted(text: Column) -> Column:
    """The canonical JSON of a string without control characters."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))
