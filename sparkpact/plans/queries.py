"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import format_column
from ..functions.patterns import compile_pattern
from ..operators import columns, nodes, pairs, typed
from . import verdicts
from .contracts import warehouse
from .schema import Schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(operation: str) -> Schema:
    return warehouse()[operation].body


def checked(name: str, operation: str, table_name: str, keys: list[str], words: dict[str, str], only: dict[str, str]) -> None:
    """A query of all violations of some columns. words: 'column keyword' -> SQL that is true where it is violated.

    only: the columns, each with an expression of the table's that gives its value, in SQL that Spark and DuckDB share.
    """
    from_ = f"(SELECT {', '.join([*keys, *(f'{e} AS {c}' for c, e in only.items())])} FROM {table_name})"
    select = " UNION ALL ".join(
        f"SELECT {', '.join(keys)}, '#/{w.split()[0]}' AS pointer, '{w.split()[1]}' AS keyword FROM {from_} WHERE {test}" for w, test in words.items()
    )

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole = body(operation)
        # the rules of these columns alone, without what the object requires besides
        schema = Schema(whole.pointer, properties={c: whole.properties[c] for c in only if c in whole.properties}, required=[n for n in whole.required if n in only], all_of=whole.all_of)
        rows = table(spark, sf_dir, table_name).select(*keys, *[F.expr(e).alias(c) for c, e in only.items()])
        return typed.table_violations(rows, schema, keys, list(only)).select(*keys, "pointer", "keyword")

    run.__doc__ = f"Rows of {table_name} that break the {operation} contract; null columns are absent properties."
    QUERIES[name], SQL[name] = run, select


def _as_is(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


LINE = ["l_orderkey", "l_linenumber"]
DECIMAL = "CAST(CAST({0} AS VARCHAR) AS DECIMAL(38,12))"

_FLAGSHIP = {
    "l_quantity type": "isnan(l_quantity) OR isinf(l_quantity)",
    "l_discount type": "isnan(l_discount) OR isinf(l_discount)",
    "l_tax type": "isnan(l_tax) OR isinf(l_tax)",
    "l_quantity minimum": "l_quantity < 5",
    "l_quantity maximum": "l_quantity > 45",
    "l_discount exclusiveMinimum": "l_discount <= 0",
    "l_discount exclusiveMaximum": "CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(38,12)) >= 0.1",
    "l_tax multipleOf": f"{DECIMAL.format('l_tax')} % 0.02 <> 0",
    "l_extendedprice type": "l_extendedprice <> floor(l_extendedprice)",
    "l_returnflag enum": "l_returnflag NOT IN ('A', 'N')",
    "l_linestatus pattern": "NOT regexp_matches(l_linestatus, '^[OP]\\z')",
    "l_linestatus minLength": "length(l_linestatus) < 1",
    "l_linestatus maxLength": "length(l_linestatus) > 1",
    "l_linenumber maximum": "l_linenumber > 6",
    "l_linenumber format": "false",
    "l_orderkey minimum": "l_orderkey < 0",
    "l_orderkey format": "false",
    "l_partkey minimum": "l_partkey < 0",
    "l_partkey format": "false",
    "l_orderkey required": "l_orderkey IS NULL",
    "l_linenumber required": "l_linenumber IS NULL",
    "l_quantity required": "l_quantity IS NULL",
    "l_shipmode required": "true",
}


@query(
    "entry",
    "SELECT pointer, keyword, sum(n)::BIGINT AS violations FROM ("
    + " UNION ALL ".join(f"SELECT '#/{w.split()[0]}' AS pointer, '{w.split()[1]}' AS keyword, count(*) FILTER ({t}) AS n FROM lineitem" for w, t in _FLAGSHIP.items())
    + ") GROUP BY ALL",
)
def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lineitem rows break each rule of the contract, in one scan."""
    return typed.violation_counts(table(spark, sf_dir, "lineitem"), body("lineitem"))


# typed plan
checked("v06_minimum", "lineitem", "lineitem", LINE, {k: _FLAGSHIP[k] for k in ("l_quantity minimum", "l_quantity maximum")}, _as_is("l_quantity"))
checked("v08_maximum", "lineitem", "lineitem", ["l_orderkey"], {"l_linenumber maximum": "l_linenumber > 6"}, {"l_linenumber": "l_linenumber"})
checked(
    "v07_v09_exclusive", "lineitem", "lineitem", LINE,
    {k: _FLAGSHIP[k] for k in ("l_discount exclusiveMinimum", "l_discount exclusiveMaximum")}, _as_is("l_discount"),
)
checked("v10_multiple_of", "lineitem", "lineitem", LINE, {"l_tax multipleOf": _FLAGSHIP["l_tax multipleOf"]}, _as_is("l_tax"))
checked("v03_type_integer", "lineitem", "lineitem", LINE, {"l_extendedprice type": _FLAGSHIP["l_extendedprice type"]}, _as_is("l_extendedprice"))
checked("v04_enum", "order", "orders", ["o_orderkey"], {"o_orderpriority enum": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"}, _as_is("o_orderpriority"))
checked("v10_multiple_of_price", "order", "orders", ["o_orderkey"], {"o_totalprice multipleOf": f"{DECIMAL.format('o_totalprice')} % 0.5 <> 0"}, _as_is("o_totalprice"))
checked("v13_length", "document", "documents", ["doc_id"], {"text minLength": "length(text) < 100", "text maxLength": "length(text) > 5000"}, _as_is("text"))
checked("v14_pattern", "part", "part", ["p_partkey"], {"p_brand pattern": "NOT regexp_matches(p_brand, '^Brand#[1-2][0-9]?\\z')"}, _as_is("p_brand"))
checked("e09_word_boundary", "part", "part", ["p_partkey"], {"p_name pattern": "NOT regexp_matches(p_name, '\\bpart\\b')"}, _as_is("p_name"))
checked("v12_float_format", "part", "part", ["p_partkey"], {"p_retailprice format": "p_retailprice >= 3.4028235677973366e38"}, {"p_retailprice": "p_retailprice * 2.3e35"})
checked("e10_lookahead", "document", "documents", ["doc_id"], {"lang pattern": "NOT (NOT regexp_matches(lang, '^fr') AND regexp_matches(lang, '^[a-z]{2}\\z'))"}, _as_is("lang"))
checked("e03_digit_escape", "document", "documents", ["doc_id"], {"source pattern": "NOT regexp_matches(source, '^src[0-9]\\z')"}, _as_is("source"))
checked("v03_nullable", "embedding", "embeddings", ["vec_id"], {"label maximum": "label > 7"}, _as_is("label"))
checked("v19_required", "order", "orders", ["o_orderkey"], {"o_orderstatus required": "o_orderstatus IS NULL", "o_orderstatus enum": "o_orderstatus NOT IN ('O', 'F')"}, {"o_orderstatus": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END"})
checked(
    "v23_all_of", "customer", "customer", ["c_custkey"],
    {"c_acctbal minimum": "c_acctbal < 0", "c_acctbal maximum": "c_acctbal > 9000", "c_mktsegment enum": "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"},
    _as_is("c_acctbal", "c_mktsegment"),
)
# numbers at the edges of doubles, worked by hand: x is of type number, positive, at most 1e29 and a multiple of 0.05; n is an integer
_EDGES = ["1e-13", "1e30", "-0.0", "5e-324", "NaN", "Infinity", "0.1", "-2.5", "0.15000000000000002", "1e22"]
_EDGE_RULES = [
    (0, "x", "multipleOf"), (0, "n", "type"), (1, "x", "maximum"), (2, "x", "exclusiveMinimum"), (3, "x", "multipleOf"), (3, "n", "type"), (4, "x", "type"), (4, "n", "type"),
    (5, "x", "type"), (5, "n", "type"), (6, "n", "type"), (7, "x", "exclusiveMinimum"), (7, "n", "type"), (8, "x", "multipleOf"), (8, "n", "type"),
]


@query(
    "v05_edges_of_doubles",
    "SELECT c_custkey, '#/' || name AS pointer, keyword FROM customer JOIN (VALUES "
    + ", ".join(f"({i}, '{n}', '{w}')" for i, n, w in _EDGE_RULES)
    + f") v(i, name, keyword) ON c_custkey % {len(_EDGES)} = i",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles that decimals of a fixed scale get wrong, and those that are no JSON numbers."""
    x = F.element_at(F.array(*[F.lit(e).cast("double") for e in _EDGES]), (F.col("c_custkey") % len(_EDGES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), x.alias("n"))
    return typed.table_violations(rows, body("edge"), ["c_custkey"]).select("c_custkey", "pointer", "keyword")


@query(
    "v16_array_size",
    "SELECT vec_id, '#/embedding' AS pointer, CASE WHEN vec_id % 7 < 2 THEN 'minItems' ELSE 'maxItems' END AS keyword FROM embeddings WHERE vec_id % 7 < 2 OR vec_id % 7 > 4",
)
def array_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of 60 to 66 elements where 62 to 64 are allowed."""
    from ..functions.exact import Num

    schema = Schema("#", properties={"embedding": Schema("#/e", type="array", min_items=Num.of(62), max_items=Num.of(64))})
    long = F.concat("embedding", "embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(long, 1, (60 + F.col("vec_id") % 7).cast("int")).alias("embedding"))
    return typed.table_violations(rows, schema, ["vec_id"]).select("vec_id", "pointer", "keyword")


@query(
    "v16_v17_items",
    """SELECT vec_id, idx::INT AS idx, CASE WHEN x < -0.3 THEN 'minimum' ELSE 'maximum' END AS keyword
       FROM (SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding) AS f,
                    CAST(CAST(unnest(embedding) AS VARCHAR) AS DOUBLE) AS x FROM embeddings) WHERE x < -0.3 OR x > 0.3""",
)
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of embeddings outside their bounds."""
    rows = table(spark, sf_dir, "embeddings")
    return typed.array_items(rows, "embedding", body("embedding").properties["embedding"], ["vec_id"]).select("vec_id", "idx", "keyword")


@query("v24_any_of", "SELECT p_partkey, p_size <= 10 OR p_type = 'PROMO' AS valid FROM part")
def any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the part contract's alternatives holds."""
    rows = table(spark, sf_dir, "part")
    alternatives = Schema("#", any_of=body("part").any_of)
    return rows.select("p_partkey", typed.is_valid(rows, alternatives).alias("valid"))


@query("v20_valid_rows", "SELECT count(*) FILTER (o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS valid, count(*) AS n FROM orders")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders meet the rules for status and priority."""
    rows = table(spark, sf_dir, "orders")
    return rows.agg(F.count_if(typed.is_valid(rows, body("order"), ["o_orderstatus", "o_orderpriority"])).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("c05_enum_dedupe", "SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM')) t(idx, member)")
def enum_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enum's distinct members in authored order."""
    return spark.createDataFrame(list(enumerate(body("order").properties["o_orderpriority"].enum)), "idx int, member string")


@query("v04_enum_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum membership as a left-semi join; the enum's size is the contract's."""
    members = spark.createDataFrame([(m,) for m in body("order").properties["o_orderpriority"].enum], "o_orderpriority string")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(F.broadcast(members), "o_orderpriority", "left_semi").select("o_orderkey")


# formats, on values built from columns: of each list, the turn of the row's key chooses one, and whether it conforms is known
_FORMAT_VALUES: dict[str, list[tuple[str, bool]]] = {
    "uuid": [
        ("concat(lpad(cast(o_orderkey as string), 8, '0'), '-1234-4abc-8def-0123456789ab')", True), ("concat(lpad(cast(o_orderkey as string), 8, '0'), '-1234-4ABC-bDEF-0123456789AB')", True),
        ("concat(lpad(cast(o_orderkey as string), 8, '0'), '-1234-5abc-8def-0123456789ab')", False), ("concat(lpad(cast(o_orderkey as string), 8, '0'), '-1234-4abc-cdef-0123456789ab')", False),
        ("concat(lpad(cast(o_orderkey as string), 7, '0'), '-1234-4abc-8def-0123456789ab')", False),
    ],
    "ipv4": [("concat('10.', o_orderkey % 256, '.0.', o_custkey % 256)", True), ("concat('10.', 256 + o_orderkey % 700, '.0.1')", False), ("concat('10.0', o_orderkey % 10, '.1.1')", False), ("concat('10.1.', o_orderkey % 200)", False)],
    "cidr": [("concat('10.0.0.0/', o_orderkey % 33)", True), ("concat('10.0.0.0/', 33 + o_orderkey % 60)", False), ("concat('10.0.0.0/0', o_orderkey % 10)", False), ("concat('10.0.0.', 256 + o_orderkey % 9, '/8')", False), ("'10.0.0.0'", False)],
    "byte": [("'YWJj'", True), ("'YWI='", True), ("'YQ=='", True), ("''", True), ("'YWJ'", False), ("'YW=='", False), ("'YQ=a'", False), ("'YW-_'", False), ("concat('YWJj', chr(10))", False)],
    "date": [("concat('2024-02-', lpad(cast(1 + o_orderkey % 29 as string), 2, '0'))", True), ("concat('2023-02-', 29 + o_orderkey % 2)", False), ("concat('1999-13-', 10 + o_orderkey % 10)", False), ("concat('1999-1-', 10 + o_orderkey % 10)", False), ("'1900-02-29'", False), ("'2000-02-29'", True)],
    "date-time": [
        ("concat('2024-02-29T', lpad(cast(o_orderkey % 24 as string), 2, '0'), ':59:59Z')", True), ("concat('2024-02-29T00:00:00.', o_orderkey, '+01:00')", True), ("concat('2024-02-29t00:00:00.', o_orderkey, 'Z')", False), ("concat('2024-02-29T', 24 + o_orderkey % 70, ':00:00Z')", False),
        ("concat('2023-02-29T0', o_orderkey % 10, ':00:00Z')", False), ("concat('2024-02-29 0', o_orderkey % 10, ':00:00Z')", False), ("'2024-02-29T00:00:00'", False), ("'2024-02-29T00:60:00Z'", False),
    ],
}


def _turn(listed: list[str], key: str) -> str:
    return f"CASE {key} % {len(listed)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(listed)) + " END"


def _format_query(name: str) -> None:
    values, verdicts = (_turn([str(x[k]).lower() if k else x[0] for x in _FORMAT_VALUES[name]], "o_custkey") for k in (0, 1))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(values).alias("value"))
        return rows.select("o_orderkey", "value", format_column(name, F.col("value")).alias("ok"))

    run.__doc__ = f"The format {name} on values made from orders."
    key = {"uuid": "f01", "ipv4": "f02", "cidr": "f03", "byte": "f04", "date": "f05", "date-time": "f06"}[name]
    QUERIES[f"{key}_{name.replace('-', '_')}"] = run
    SQL[f"{key}_{name.replace('-', '_')}"] = f"SELECT o_orderkey, {values.replace('as string', 'as varchar')} AS value, {verdicts} AS ok FROM orders"


for _name in _FORMAT_VALUES:
    _format_query(_name)


@query(
    "f07_email",
    r"""SELECT c_custkey, value, regexp_full_match(value, '[A-Za-z0-9#.]+@[A-Za-z0-9-]+\.example') AND NOT contains(value, '..') AND length(split_part(value, '@', 1)) <= 64 AS ok
        FROM (SELECT c_custkey, replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '..' ELSE '.' END) || '@' || lower(c_mktsegment) || '.example' AS value FROM customer)""",
)
def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format email on addresses made from customers."""
    dots = F.when(F.col("c_custkey") % 3 == 0, "..").otherwise(".")
    value = F.concat(F.replace("c_name", F.lit("#"), dots), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))
    return rows.select("c_custkey", "value", format_column("email", F.col("value")).alias("ok"))


@query("e11_utf16_units", "SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) <= 400 AS short FROM documents")
def utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns count UTF-16 units: texts of 400 at most."""
    short = compile_pattern("^[^]{0,400}$").column(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", short.alias("short"))


@query("e13_ascii_policy", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7f]') AND regexp_matches(text, 'the') AS ok FROM documents")
def ascii_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that rejects non-ASCII subjects."""
    return table(spark, sf_dir, "documents").select("doc_id", compile_pattern("the", reject_non_ascii=True).column(F.col("text")).alias("ok"))


@query("e12_native_pattern", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[3-5]') AS ok FROM part")
def native_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern in the engine's own syntax."""
    return table(spark, sf_dir, "part").select("p_partkey", compile_pattern("^Brand#[3-5]", use_native=True).column(F.col("p_brand")).alias("ok"))


# raw JSON
@query("j04_canonical_hash", "SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS canonical, sha256('{\"k\":' || (props->>'$.k') || '}') AS hash FROM events")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON and its hash."""
    return table(spark, sf_dir, "events").select("event_id", columns.strict_nodes(F.col("props")).alias("s")).select("event_id", "s.canonical", "s.hash")


@query("j01_strict_parse", "SELECT event_id, NOT (event_id % 4 = 1 OR event_id % 4 = 2) AS strict FROM events")
def strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictness: text after the value and repeated names are refused, white space is not."""
    case = F.col("event_id") % 4
    text = (
        F.when(case == 1, F.concat("props", F.lit(" x")))
        .when(case == 2, F.concat(F.lit('{"k":1,'), F.substring("props", 2, 1 << 20)))
        .when(case == 3, F.concat(F.lit(" \n"), "props", F.lit("\t")))
        .otherwise(F.col("props"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("props"))
    return rows.select("event_id", columns.canonical_json(F.col("props")).isNotNull().alias("strict"))


@query(
    "j02_nodes",
    """SELECT event_id, '#' AS pointer, 'object' AS kind, 1 AS size, NULL AS text FROM events
       UNION ALL SELECT event_id, '#/k', 'number', NULL, props->>'$.k' FROM events""",
)
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of events.props."""
    found = nodes.node_table(table(spark, sf_dir, "events"), "props", ["event_id"])
    return found.select("event_id", "pointer", "kind", "size", F.when(F.col("kind") == "number", F.col("text")).alias("text"))


@query("j05_distinct_values", "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by semantic equality: white space and number spelling don't count."""
    spelled = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"(\d+)\}", "$1.0 }")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(columns.canonical_json(spelled).alias("c"))
    return rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(F.regexp_extract("c", r":(.*)\}", 1).alias("k"), "n").withColumn("k", _plain_integer(F.col("k")))


def _plain_integer(lexeme: Column) -> Column:
    """A canonical integer spelled out: 1e1 is 10."""
    return lexeme.cast("decimal(38,0)").cast("bigint").cast("string")


def _props_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return warehouse()["props"].validate(rows.select("event_id", "props"), "props")


_K = "CAST(props->>'$.k' AS BIGINT)"


@query(
    "v26_error_rows",
    f"""SELECT event_id, '#/k' AS pointer, '#/components/schemas/props/properties/k' AS schema_pointer,
               CASE WHEN {_K} < 10 THEN 'minimum' ELSE 'maximum' END AS keyword,
               CASE WHEN {_K} < 10 THEN 'value must be greater than or equal to 10' ELSE 'value must be less than or equal to 89' END AS reason
        FROM events WHERE {_K} < 10 OR {_K} > 89""",
)
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failure of events.props, with both pointers and the reason."""
    return _props_errors(spark, sf_dir).select("event_id", F.inline("errors")).withColumnRenamed("instance_pointer", "pointer")


@query("v01_body_presence", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'requestBody' WHEN 1 THEN 'body' END AS keyword FROM events")
def body_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text is an absent body, white space alone a parse failure."""
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "  ").otherwise('{"k":50}')
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("props"))
    return warehouse()["props"].validate(rows, "props").select("event_id", F.get("errors", F.lit(0))["keyword"].alias("keyword"))


@query("v22_closed", "SELECT event_id, '#/z' AS pointer, 'additionalProperties' AS keyword FROM events UNION ALL SELECT event_id, '#/y', 'additionalProperties' FROM events UNION ALL SELECT event_id, '#', 'maxProperties' FROM events UNION ALL SELECT event_id, '#/k', 'required' FROM events")
def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed object with two undeclared members and none of those required."""
    text = F.concat(F.lit('{"z":'), F.col("event_id"), F.lit("}"))
    two = F.replace(text, F.lit("}"), F.lit(',"y":0}'))
    rows = table(spark, sf_dir, "events").select("event_id", two.alias("props"))
    found = nodes.violations(nodes.node_table(rows, "props", ["event_id"]), nodes.rule_table(spark, body("props")), ["event_id"])
    return found.select("event_id", "pointer", "keyword")


@query(
    "n01_rule_join",
    f"SELECT event_id, '#/k' AS pointer, CASE WHEN {_K} < 10 THEN 'minimum' ELSE 'maximum' END AS keyword FROM events WHERE {_K} < 10 OR {_K} > 89",
)
def rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table joined with the rule table: the failures of v26_error_rows, by joins."""
    found = nodes.violations(nodes.node_table(table(spark, sf_dir, "events"), "props", ["event_id"]), nodes.rule_table(spark, body("props")), ["event_id"])
    return found.select("event_id", "pointer", "keyword")


@query(
    "v17_nested_items",
    """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
       SELECT conv_id, '#' AS pointer, 'minItems' AS keyword FROM t GROUP BY conv_id HAVING count(*) < 5
       UNION ALL SELECT conv_id, '#/' || i || '/role', 'enum' FROM t WHERE role NOT IN ('user', 'assistant')
       UNION ALL SELECT conv_id, '#/' || i || '/turn', 'maximum' FROM t WHERE turn > 5
       UNION ALL SELECT conv_id, '#/' || i || '/text', 'maxLength' FROM t WHERE length(text) > 400""",
)
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON arrays of turns: items, required, enum, and a schema for undeclared members."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    found = warehouse()["turns"].validate(turns.select("conv_id", F.to_json("turns").alias("body")), "body")
    return found.select("conv_id", F.inline("errors")).select("conv_id", F.col("instance_pointer").alias("pointer"), "keyword")


@query("j09_number_compare", "SELECT o_orderkey, o_totalprice < 1000.5 AS below FROM orders")
def number_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact comparison by sign, magnitude and digits."""
    from ..functions.exact import Num

    bound = Num.parse("1000.5")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.array(F.col("o_totalprice").cast("decimal(18,2)"))).alias("j"))
    found = nodes.node_table(rows, "j", ["o_orderkey"]).filter("kind = 'number'")
    less = nodes._less(F.col("num_neg"), F.col("num_mag"), F.col("num_digits"), F.lit(False), F.lit(bound.mag).cast("bigint"), F.lit(bound.digits))
    return found.select("o_orderkey", less.alias("below"))


@query("j10_is_integer", "SELECT o_orderkey, o_totalprice = floor(o_totalprice) AS whole FROM orders")
def whole_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mathematical integers, however spelled."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.array(F.col("o_totalprice").cast("decimal(18,2)"))).alias("j"))
    return nodes.node_table(rows, "j", ["o_orderkey"]).filter("kind = 'number'").select("o_orderkey", (F.col("num_exp") >= 0).alias("whole"))


@query("d06_pointer_escape", "SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS token FROM pages")
def pointer_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as JSON Pointer tokens."""
    return table(spark, sf_dir, "pages").select("page_id", nodes.pointer_token(F.col("url")).alias("token"))


@query("d11_parameter_overlay", "SELECT * FROM (VALUES ('openPage', 0, 'id', 'path', 'string'), ('openPage', 1, 'lang', 'path', 'string'), ('openPage', 2, 'ref', 'query', 'string'), ('openPage', 3, 'rest', 'query', 'object'), ('page', 0, 'id', 'path', 'integer'), ('page', 1, 'lang', 'path', 'string'), ('page', 2, 'page', 'query', 'integer'), ('page', 3, 'ref', 'query', 'string')) t(operation, position, name, location, type)")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path Item parameters overridden by an operation's own, in place: the parameters of each operation of the warehouse."""
    from ..sources.document import Document
    from .contracts import DOCUMENT

    found = Document(DOCUMENT).operations()
    rows = [
        (op.operation_id, i, name, where, p.value["schema"]["type"])
        for op in found.values()
        for i, ((name, where), p) in enumerate(op.all_parameters)
    ]
    return spark.createDataFrame(rows, "operation string, position int, name string, location string, type string")


@query("s10_rule_table", "SELECT * FROM (VALUES ('#', 'additionalProperties'), ('#', 'maxProperties'), ('#', 'properties'), ('#', 'required'), ('#', 'type'), ('#/k', 'maximum'), ('#/k', 'minimum'), ('#/k', 'type')) t(template, keyword)")
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props contract as data."""
    return nodes.rule_table(spark, body("props")).select("template", "keyword")


# queries and paths
_RAW = "coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '')"
_PAIRS = f"""pairs AS (SELECT page_id, (i - 1)::INT AS pos, split_part(part, '=', 1) AS raw_name, CASE WHEN contains(part, '=') THEN substr(part, strpos(part, '=') + 1) ELSE '' END AS raw_value
  FROM (SELECT page_id, unnest(string_split(q, '&')) AS part, unnest(range(1, len(string_split(q, '&')) + 1)) AS i FROM (SELECT page_id, {_RAW} AS q FROM pages) WHERE q <> '')),
named AS (SELECT page_id, pos, url_decode(replace(raw_name, '+', ' ')) AS name, url_decode(replace(raw_value, '+', ' ')) AS value FROM pairs)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.query_pairs(table(spark, sf_dir, "pages"), pairs.raw_query(F.col("url")), ["page_id"])


@query("s05_raw_query", f"SELECT page_id, {_RAW} AS raw FROM pages")
def raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw queries of URLs."""
    return table(spark, sf_dir, "pages").select("page_id", pairs.raw_query(F.col("url")).alias("raw"))


@query("s06_raw_path", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def raw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped paths of URLs."""
    return table(spark, sf_dir, "pages").select("page_id", pairs.raw_path(F.col("url")).alias("path"))


@query("q01_pairs", f"WITH {_PAIRS} SELECT * FROM named")
def lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded name/value pairs of queries, in wire order."""
    return _pairs(spark, sf_dir).select("page_id", "pos", "name", "value")


@query("q02_brackets", f"WITH {_PAIRS} SELECT page_id, pos, regexp_matches(raw_name, '[\\[\\]]') AS bad FROM pairs")
def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with raw brackets, which no query may hold."""
    return _pairs(spark, sf_dir).select("page_id", "pos", pairs.bad_brackets(F.col("raw_name")).alias("bad"))


@query("q03_claims", f"WITH {_PAIRS} SELECT page_id, name, name AS parameter FROM named WHERE name IN ('page', 'ref')")
def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the parameter that owns their name."""
    return pairs.claims(_pairs(spark, sf_dir), warehouse()["page"].query).filter("parameter is not null").select("page_id", "name", "parameter")


@query("q05_open_form", f"WITH {_PAIRS} SELECT page_id, name, CASE WHEN name = 'ref' THEN 'ref' ELSE 'rest' END AS parameter, CASE WHEN name <> 'ref' THEN name END AS property FROM named")
def open_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open object takes the pairs that nobody else owns."""
    return pairs.claims(_pairs(spark, sf_dir), warehouse()["openPage"].query).select("page_id", "name", "parameter", "property")


@query("q06_unknown", f"WITH {_PAIRS} SELECT page_id, name FROM named WHERE name NOT IN ('page', 'ref')")
def unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that nobody owns, by an anti join with the owner table."""
    owners = pairs.owner_table(_pairs(spark, sf_dir), warehouse()["page"].query)
    return _pairs(spark, sf_dir).join(F.broadcast(owners), "name", "left_anti").select("page_id", "name")


@query(
    "q09_defaults",
    f"""WITH {_PAIRS}, first AS (SELECT page_id, arg_min(value, pos) FILTER (name = 'page') AS page, arg_min(value, pos) FILTER (name = 'ref') AS ref FROM named GROUP BY page_id)
        SELECT pages.page_id, coalesce(page, '1') AS page, ref FROM pages LEFT JOIN first USING (page_id)""",
)
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter's first value, or its default."""
    decoder = warehouse()["page"].query
    return pairs.with_defaults(table(spark, sf_dir, "pages"), pairs.claims(_pairs(spark, sf_dir), decoder), decoder, ["page_id"])


@query(
    "q18_decoded_query",
    f"""WITH {_PAIRS}, agg AS (SELECT page_id, list(value ORDER BY pos) FILTER (name = 'page') AS p, list(value ORDER BY pos) FILTER (name = 'ref') AS r FROM named GROUP BY page_id),
        one AS (SELECT pages.page_id, coalesce(p, []) AS p, coalesce(r, []) AS r FROM pages LEFT JOIN agg USING (page_id))
        SELECT page_id, CASE WHEN len(p) > 1 OR len(r) > 1 OR list_contains(p, '') OR list_contains(r, '') OR (len(p) = 1 AND (try_cast(p[1] AS BIGINT) IS NULL OR try_cast(p[1] AS BIGINT) > 5)) THEN NULL
          ELSE '{{"page":' || CASE WHEN len(p) = 1 THEN (try_cast(p[1] AS BIGINT))::VARCHAR ELSE '1' END || CASE WHEN len(r) = 1 THEN ',"ref":"' || r[1] || '"' ELSE '' END || '}}' END AS value FROM one""",
)
def decoded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole queries decoded and validated; null where that fails."""
    rows = table(spark, sf_dir, "pages").select("page_id", pairs.raw_query(F.col("url")).alias("raw"))
    return rows.select("page_id", warehouse()["page"].decode_query(F.col("raw"))["value"].alias("value"))


@query("p01_segments", "SELECT page_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS segment FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS s FROM pages)")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths split at raw slashes."""
    return pairs.path_segments(table(spark, sf_dir, "pages"), pairs.raw_path(F.col("url")), ["page_id"])


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    "p02_path",
    f"SELECT page_id, CASE WHEN regexp_full_match({_PATH}, '/[^/]*/[^/]*') THEN url_decode(split_part({_PATH}, '/', 2)) END AS lang, CASE WHEN regexp_full_match({_PATH}, '/[^/]*/[^/]*') THEN url_decode(split_part({_PATH}, '/', 3)) END AS id FROM pages",
)
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's captures, decoded, without conversion."""
    found = pairs.path_captures(pairs.raw_path(F.col("url")), warehouse()["page"].path)
    return table(spark, sf_dir, "pages").select("page_id", found["lang"].alias("lang"), found["id"].alias("id"))


@query(
    "p13_decoded_path",
    f"""SELECT page_id, CASE WHEN regexp_full_match({_PATH}, '/(de|en|es)/[0-9]+') AND try_cast(split_part({_PATH}, '/', 3) AS BIGINT) <= 150
        THEN '{{"lang":"' || split_part({_PATH}, '/', 2) || '","id":' || (split_part({_PATH}, '/', 3)::BIGINT) || '}}' END AS value FROM pages""",
)
def decoded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paths decoded and validated, in the template's order; canonical numbers are spelled out."""
    rows = table(spark, sf_dir, "pages").select("page_id", pairs.raw_path(F.col("url")).alias("raw"))
    value = warehouse()["page"].decode_path(F.col("raw"))["value"]
    lexeme = F.regexp_extract(value, r'"id":([^}]*)\}', 1)
    return rows.select("page_id", F.when(value.isNotNull(), F.concat(F.regexp_extract(value, r'\A(.*"id":)', 1), _plain_integer(lexeme), F.lit("}"))).alias("value"))


@query("p08_percent_decode", "SELECT page_id, url_decode(url) AS text FROM pages")
def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path escapes decoded once; + stays +."""
    return table(spark, sf_dir, "pages").select("page_id", pairs.unescaped(F.col("url"), False).alias("text"))


_ESCAPES = [("%EF%BF%BD", "\ufffd"), ("%EF%BF%BD%FF", None), ("\ufffd%FF", None), ("%C3%A9+", "é+"), ("%C3", None), ("%ED%A0%80", None), ("%4", None), ("%zz", None), ("%F0%EF%BF%BD", None), ("a%00b", "a\0b"), ("%25%34", "%4")]


@query("p08_malformed_escapes", "SELECT page_id, " + _turn(["NULL" if v is None else "'a'||chr(0)||'b'" if "\0" in v else f"'{v}'" for _, v in _ESCAPES], "page_id") + " AS text FROM pages")
def malformed_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes that are malformed, or not UTF-8, beside such that spell the replacement character."""
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in _ESCAPES]), (F.col("page_id") % len(_ESCAPES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", pairs.unescaped(raw, False).alias("text"))


# coverage
@query(
    "agg_coverage",
    "SELECT pointer || ' ' || keyword AS obligation, n > 0 AS covered FROM (SELECT pointer, keyword, sum(n) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '#/{w.split()[0]}' AS pointer, '{w.split()[1]}' AS keyword, count(*) FILTER ({t}) AS n FROM lineitem" for w, t in _FLAGSHIP.items())
    + ") GROUP BY ALL)",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules of the lineitem contract some row breaks."""
    return entry(spark, sf_dir).select(F.concat_ws(" ", "pointer", "keyword").alias("obligation"), (F.col("violations") > 0).alias("covered"))


@query(
    "x01_stream_verdicts",
    f"SELECT CASE WHEN {_K} < 10 OR {_K} > 89 THEN 1 ELSE 0 END AS errors, count(*) AS n FROM events GROUP BY 1",
)
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events validated as a stream, its verdicts counted."""
    from ..streaming.validate import validated_stream, written

    # by a pattern, as a stream's plain path must be a folder and a table may be a single file
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    done = written(validated_stream(rows, warehouse()["props"], "props").select("event_id", F.size("errors").alias("errors")))
    return done.groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


# wire cells: values of part spelled in each style, decoded and validated
_INT = {"type": "integer"}
_STR = {"type": "string"}
_BOX = {"type": "object", "properties": {"brand": _STR, "size": _INT}, "additionalProperties": False}
_BRAND, _BRAND_SQL = "replace(p_brand, '#', '%23')", "p_brand"
#: name -> (schema and style of parameter p, raw spelling, JSON of the value); both in SQL that Spark and DuckDB share
CELLS: dict[str, tuple[dict, str, str]] = {
    "q11_primitive": ({"schema": _INT}, "concat('p=', p_size)", "p_size"),
    "q12_form_array": ({"schema": {"type": "array", "items": _INT}}, "concat('p=', p_size, '&p=7')", "concat('[', p_size, ',7]')"),
    "q13_comma_array": ({"schema": {"type": "array", "items": _STR}, "explode": False}, f"concat('p=a%2Cb,', {_BRAND})", "concat('[\"a,b\",\"', p_brand, '\"]')"),
    "q13_space_array": ({"schema": {"type": "array", "items": _INT}, "style": "spaceDelimited", "explode": False}, "concat('p=', p_size, '+3%205')", "concat('[', p_size, ',3,5]')"),
    "q13_pipe_array": ({"schema": {"type": "array", "items": _INT}, "style": "pipeDelimited", "explode": False}, "concat('p=', p_size, '%7C3')", "concat('[', p_size, ',3]')"),
    "q14_named_object": ({"schema": _BOX, "explode": False}, f"concat('p=size,', p_size, ',brand,', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "q15_exploded_object": ({"schema": _BOX}, f"concat('size=', p_size, '&other=1&brand=', {_BRAND})", "concat('{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}')"),
    "q04_deep_object": ({"schema": {**_BOX, "additionalProperties": _INT}, "style": "deepObject", "explode": True}, "concat('p%5Bz%5D=4&p%5Bsize%5D=', p_size)", "concat('{\"size\":', p_size, ',\"z\":4}')"),
    "q16_json_content": ({"content": {"application/json": {"schema": {"type": "object"}}}}, "concat('p=%7B%22n%22%3A', p_size, '%7D')", "concat('{\"n\":', p_size, '}')"),
    "q17_split_before_unescape": ({"schema": {"type": "array", "items": _STR}, "explode": False}, "concat('p=x%2Cy,', p_size)", "concat('[\"x,y\",\"', p_size, '\"]')"),
    "q19_any_of": ({"schema": {"anyOf": [{"type": "integer", "maximum": 25}, _STR]}}, "concat('p=', p_size)", "CASE WHEN p_size <= 25 THEN concat(p_size, '') ELSE concat('\"', p_size, '\"') END"),
    "p04_label_primitive": ({"in": "path", "style": "label", "schema": _INT}, "concat('/v/.', p_size)", "p_size"),
    "p04_matrix_primitive": ({"in": "path", "style": "matrix", "schema": _STR}, f"concat('/v/;p=', {_BRAND})", "concat('\"', p_brand, '\"')"),
    "p04_simple_primitive": ({"in": "path", "schema": _INT}, "concat('/v/', p_size)", "p_size"),
    "p05_simple_exploded": ({"in": "path", "explode": True, "schema": {"type": "array", "items": _INT}}, "concat('/v/', p_size, ',8')", "concat('[', p_size, ',8]')"),
    "p05_label_array": ({"in": "path", "style": "label", "schema": {"type": "array", "items": _INT}}, "concat('/v/.', p_size, ',8')", "concat('[', p_size, ',8]')"),
    "p05_label_exploded": ({"in": "path", "style": "label", "explode": True, "schema": {"type": "array", "items": _INT}}, "concat('/v/.', p_size, '.8')", "concat('[', p_size, ',8]')"),
    "p05_matrix_packed": ({"in": "path", "style": "matrix", "schema": {"type": "array", "items": _INT}}, "concat('/v/;p=', p_size, ',8')", "concat('[', p_size, ',8]')"),
    "p06_simple_exploded": ({"in": "path", "explode": True, "schema": _BOX}, f"concat('/v/size=', p_size, ',brand=', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "p06_label_packed": ({"in": "path", "style": "label", "schema": _BOX}, f"concat('/v/.size,', p_size, ',brand,', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "p06_matrix_object": ({"in": "path", "style": "matrix", "schema": _BOX}, f"concat('/v/;p=size,', p_size, ',brand,', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "p06_matrix_exploded": ({"in": "path", "style": "matrix", "explode": True, "schema": _BOX}, f"concat('/v/;size=', p_size, ';brand=', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "p03_empty_array": ({"in": "path", "style": "label", "schema": {"type": "array", "items": _INT}}, "'/v/.'", "'[]'"),
    "p05_simple_array": ({"in": "path", "schema": {"type": "array", "items": _INT}}, "concat('/v/', p_size, ',8')", "concat('[', p_size, ',8]')"),
    "p05_matrix_array": ({"in": "path", "style": "matrix", "explode": True, "schema": {"type": "array", "items": _INT}}, "concat('/v/;p=', p_size, ';p=8')", "concat('[', p_size, ',8]')"),
    "p06_label_object": ({"in": "path", "style": "label", "explode": True, "schema": _BOX}, f"concat('/v/.size=', p_size, '.brand=', {_BRAND})", "concat('{\"size\":', p_size, ',\"brand\":\"', p_brand, '\"}')"),
    "p06_simple_object": ({"in": "path", "schema": _BOX}, "concat('/v/size,', p_size)", "concat('{\"size\":', p_size, '}')"),
    "p07_json_content": ({"in": "path", "content": {"application/json": {"schema": _INT}}}, "concat('/v/', p_size)", "p_size"),
    "p09_any_of": ({"in": "path", "schema": {"anyOf": [{"type": "integer", "minimum": 9}, _STR]}}, "concat('/v/', p_size)", "CASE WHEN p_size >= 9 THEN concat(p_size, '') ELSE concat('\"', p_size, '\"') END"),
}


def _cell(name: str) -> None:
    import functools
    import json

    parameter, raw, value = CELLS[name]
    where = parameter.get("in", "query")

    @functools.lru_cache(maxsize=1)
    def contract():
        from ..contract import compile_contract

        p = {"name": "p", "in": where, "required": True, **parameter}
        path = "/v/{p}" if where == "path" else "/v"
        return compile_contract(json.dumps({"openapi": "3.0.3", "paths": {path: {"get": {"operationId": "op", "parameters": [p]}}}}))["op"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(raw).alias("raw"))
        decode = contract().decode_path if where == "path" else contract().decode_query
        return rows.select("p_partkey", decode(F.col("raw"))["value"].alias("value"))

    run.__doc__ = f"The wire cell {name[4:].replace('_', ' ')}, on values of part."
    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, concat('{{\"p\":', {value}, '}}') AS value FROM part"


for _name in CELLS:
    _cell(_name)


@query("v11_integer_formats", "SELECT o_orderkey, o_orderkey * 100000 BETWEEN -2147483648 AND 2147483647 AS ok FROM orders")
def integer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format int32 on large whole numbers, from raw JSON."""
    schema = Schema("#", number_format="int32")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 100000).cast("string").alias("j"))
    return rows.select("o_orderkey", (F.size(columns.body_errors(schema)(F.col("j"))) == 0).alias("ok"))


@query("v18_property_counts", "SELECT event_id, event_id % 4 > 2 AS over, event_id % 4 < 1 AS under FROM events")
def property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """minProperties and maxProperties on objects of 0 to 3 members."""
    from ..functions.exact import Num

    schema = Schema("#", min_properties=Num.of(1), max_properties=Num.of(2))
    members = F.array_join(F.slice(F.array(*[F.lit(f'"m{i}":0') for i in range(3)]), 1, (F.col("event_id") % 4).cast("int")), ",")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), members, F.lit("}")).alias("j"))
    words = F.transform(columns.body_errors(schema)(F.col("j")), lambda e: e["keyword"])
    return rows.select("event_id", F.array_contains(words, "maxProperties").alias("over"), F.array_contains(words, "minProperties").alias("under"))


@query("j06_group_by_hash", "SELECT sha256('{\"k\":' || (props->>'$.k') || '}') AS hash, count(*) AS n FROM events GROUP BY 1")
def by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents counted by the hash of their canonical text."""
    rows = table(spark, sf_dir, "events").select(columns.json_hash(F.col("props")).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


@query("j11_multiple_of", "SELECT o_orderkey, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,12)) % 0.25 = 0 AS ok FROM orders")
def exact_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact divisibility of raw JSON numbers."""
    from ..functions.exact import Num

    schema = Schema("#", multiple_of=Num.parse("0.25"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("j"))
    return rows.select("o_orderkey", (F.size(columns.body_errors(schema)(F.col("j"))) == 0).alias("ok"))


QUERIES |= verdicts.QUERIES
SQL |= verdicts.SQL
