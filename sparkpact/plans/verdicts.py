"""Registered queries on the compiler's own answers: small tables whose SQL lists the rows, worked by hand."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..contract import compile_contract
from ..functions import automata, exact, formats, patterns
from ..functions.patterns import PatternError, compile_pattern
from ..sources import document
from ..sources.document import ContractError

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def listed(name: str, columns: str, want: Iterable[tuple], found: Callable[[], Iterable[tuple]], about: str) -> None:
    """A query whose rows are found() and whose SQL is a list of the rows wanted."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in want)}) t({names})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(list(found()), columns)

    run.__doc__ = about
    QUERIES[name] = run


def _error(f: Callable, *args) -> str | None:
    try:
        f(*args)
    except (ValueError, KeyError) as e:
        return type(e).__name__
    return None


def _doc(paths: dict, **more) -> str:
    return json.dumps({"openapi": "3.0.3", "paths": paths, **more})


def _body(schema: dict):
    return compile_contract(_doc({"/a": {"post": {"operationId": "op", "requestBody": {"content": {"application/json": {"schema": schema}}}}}}))["op"]


# documents
_PATHS = {"/b": {"post": {"operationId": "b2"}, "get": {"operationId": "b1"}}, "/a/{x}": {"parameters": [{"name": "x", "in": "path", "required": True, "schema": {}}], "trace": {"operationId": "a1"}, "delete": {"operationId": "a0"}}, "x-note": {}}
listed(
    "d07_requests", "position int, operation string, template string, method string",
    [(0, "a0", "/a/{x}", "delete"), (1, "a1", "/a/{x}", "trace"), (2, "b1", "/b", "get"), (3, "b2", "/b", "post")],
    lambda: [(i, o.operation_id, o.template, o.method) for i, o in enumerate(document.Document(_doc(_PATHS)).operations().values())],
    "Operations over sorted paths and the fixed order of methods.",
)
_CONTENTS = [["text/plain"], ["*/*", "application/*", "application/json"], ["*/*", "application/*"], ["Application/JSON; a=b"], ["application/json;a=b", "application/json"], ["application/xml", "*/*"]]
listed(
    "d09_media_types", "n int, chosen string",
    [(0, None), (1, "application/json"), (2, "application/*"), (3, "Application/JSON; a=b"), (4, "application/json"), (5, "*/*")],
    lambda: [(i, document.json_media_type(dict.fromkeys(c))) for i, c in enumerate(_CONTENTS)],
    "Which media type of a body stands for JSON: the most specific, an exact key first.",
)
_TEMPLATES = ["/a", "/a/{x}", "/{x}.{y}", "/{x}{y}", "/{x}/{x}", "/{}", "/{x", "/x}", "/{{x}}", "a"]


def _shape(template: str) -> tuple:
    try:
        shape, names = document.template_parts(template)
    except ContractError:
        return template, None, None
    return template, shape, ",".join(names)


listed(
    "d14_templates", "template string, shape string, names string",
    [("/a", "/a", ""), ("/a/{x}", "/a/{}", "x"), ("/{x}.{y}", "/{}.{}", "x,y"), *((t, None, None) for t in _TEMPLATES[3:])],
    lambda: map(_shape, _TEMPLATES),
    "Path templates without their names, or null where braces are out of order.",
)
listed(
    "d16_identifiers", "operation string, name string",
    [("a_b", "a__b"), ("a-b", "a_0b"), ("a/b", "a_1b"), ("class", "_xclass"), ("Z9", "Z9"), ("a-", None), ("9a", None), ("a__b", None)],
    lambda: [(o, None if _error(document.identifier, o) else document.identifier(o)) for o in ("a_b", "a-b", "a/b", "class", "Z9", "a-", "9a", "a__b")],
    "Distinct identifiers of operationIds, null for what is no operationId.",
)
_SCHEMAS = {"missing": {"$ref": "#/components/schemas/none"}, "outside": {"$ref": "a.yaml#/b"}, "self": {"items": {"$ref": "#/components/schemas/self"}}, "unique": {"uniqueItems": True}, "choice": {"discriminator": {}}, "fine": {"properties": {"uniqueItems": {}}, "example": {"$ref": "x"}}}
listed(
    "d03_exclusions", "schema string, admitted boolean",
    [("missing", False), ("outside", False), ("self", False), ("unique", False), ("choice", False), ("fine", True)],
    lambda: [(n, _error(compile_contract, _doc({}, components={"schemas": {n: s}})) is None) for n, s in _SCHEMAS.items()],
    "Schemas that no operation reaches, and whether a document may hold them.",
)

# schemas
_REFUSED = [{"oneOf": [{}]}, {"type": "null"}, {"type": "array"}, {"enum": []}, {"multipleOf": 0}, {"minLength": 1.5}, {"format": "hostname"}, {"type": "string", "format": "int32"}, {"type": "integer", "format": "double"}, {"allOf": []}, {"required": ["a", "a"]}, {"pattern": "("}, {"x-own": 1, "title": "t", "format": "password"}]
listed(
    "c02_admission", "n int, admitted boolean", [(i, i == 12) for i in range(13)], lambda: [(i, _error(_body, s) is None) for i, s in enumerate(_REFUSED)],
    "Schemas that are refused: keywords, types, formats and shapes.",
)


def _words(schema: dict, texts: list[str]) -> list[tuple]:
    own = _body(schema)
    return [(t, ",".join(v.keyword for v in own.errors(t))) for t in texts]


listed(
    "c04_nullable", "text string, keywords string", [("null", ""), ('"a"', ""), ("1", "type"), ('"long"', "maxLength")],
    lambda: _words({"type": "string", "nullable": True, "maxLength": 2}, ["null", '"a"', "1", '"long"']), "A nullable type; other rules pass null over.",
)
listed(
    "c11_read_only", "text string, keywords string", [("{}", "required"), ('{"b":1}', ""), ('{"a":1}', "required"), ('{"a":"x","b":2}', "type")],
    lambda: _words({"required": ["a", "b"], "properties": {"a": {"type": "integer", "readOnly": True}, "b": {}}}, ["{}", '{"b":1}', '{"a":1}', '{"a":"x","b":2}']), "A read-only property is not required, but checked where it stands.",
)
listed(
    "v27_count_rules", "text string, keywords string",
    [("[]", "minItems"), ("[1,2,3]", "maxItems"), ('{"a":1}', ""), ('{"a":1,"b":2}', "maxProperties"), ("{}", "minProperties"), ('"\U0001f600"', "minLength"), ('"\U0001f600b"', "")],
    lambda: _words({"items": {}, "minItems": 1, "maxItems": 2, "minProperties": 1, "maxProperties": 1, "minLength": 2, "maxLength": 2}, ["[]", "[1,2,3]", '{"a":1}', '{"a":1,"b":2}', "{}", '"\U0001f600"', '"\U0001f600b"']),
    "Counts of elements, members and code points, each for its own kind.",
)

# values
_NUMBERS = [("1.0", "1"), ("-0", "0"), ("0.001", "1e-3"), ("10e999999999", "1e1000000000"), ("12345678901234567890.1250", "12345678901234567890.125"), ("1E2", "1e2"), ("100", "100"), ("01", None), (".5", None), ("1.", None), ("+1", None), ("0.10", "0.1")]
listed(
    "j08_numbers", "text string, lexeme string", [(a, b) for a, b in _NUMBERS if a not in ("1E2", "100")] + [("1E2", "100"), ("100", "100")],
    lambda: [(a, None if _error(exact.Num.parse, a) else exact.Num.parse(a).lexeme) for a, _ in _NUMBERS], "Numbers in their canonical spelling, null for what is no JSON number.",
)
_STRINGS = ['"a\\u0041\\/"', '"\\u00e9"', '"\\n\\t"', '"\\ud83d\\ude00"', '"\\ud83d"', '"\t"', '"\\x"', '"a']
listed(
    "j13_strings", "text string, canonical string",
    [('"a\\u0041\\/"', '"aA/"'), ('"\\u00e9"', '"é"'), ('"\\n\\t"', '"\\n\\t"'), ('"\\ud83d\\ude00"', '"\U0001f600"'), ('"\\ud83d"', None), ('"\t"', None), ('"\\x"', None), ('"a', None)],
    lambda: [(t, None if _error(exact.parse, t) else exact.canonical(exact.parse(t))) for t in _STRINGS], "Strings unescaped and written again, null for what is no JSON string.",
)
listed(
    "j03_members", "text string, names string", [('{"b":1,"a":{"c":2}}', "b,a"), ("{}", ""), ('{"a":1,"\\u0061":2}', None), ('{"":0}', "")],
    lambda: [(t, None if _error(exact.parse, t) else ",".join(exact.parse(t))) for t in ('{"b":1,"a":{"c":2}}', "{}", '{"a":1,"\\u0061":2}', '{"":0}')], "The names of an object's members in their order, null where one is repeated.",
)

# patterns and formats
_FOUND = [("^a+$", "aa", True), ("^a+$", "aab", False), ("b", "abc", True), (r"\bb\b", "a b", True), (r"\bb\b", "ab", False), ("^(?:a|b){2}$", "ab", True), ("^[^a-c]$", "d", True), ("^.$", "\n", False), (r"^\s$", "﻿", True), ("^(?=.*1)[a-z1]{3}$", "a1b", True), ("^(?!a)[a-z]+$", "ab", False), ("^.{2}$", "\U0001f600", True), (r"^\cJ\x41B$", "\nAB", True)]
listed(
    "e01_patterns", "n int, found boolean", [(i, w) for i, (*_, w) in enumerate(_FOUND)], lambda: [(i, compile_pattern(p).matches(s)) for i, (p, s, _) in enumerate(_FOUND)],
    "ECMAScript 5.1 patterns on subjects: classes, groups, edges, lookaheads and UTF-16 units.",
)
listed(
    "f10_automata", "n int, accepted boolean", [(i, w) for i, (*_, w) in enumerate(_FOUND)], lambda: [(i, automata.pattern_language(p).accepts(s)) for i, (p, s, _) in enumerate(_FOUND)],
    "The same by deterministic automata.",
)
_KINDS = [("a)", "syntax"), ("(a", "syntax"), ("[a", "syntax"), ("a{2,1}", "syntax"), ("*", "syntax"), ("(a)\\1", "unsupported"), ("a(?=b)", "unsupported"), ("(?<n>a)", "foreign"), ("\\p{L}", "foreign"), ("a{1001}", "complexity"), ("(?:a{100}){100}", "complexity"), ("a++", "foreign"), ("\\u{41}", "foreign"), ("ok", None)]


def _kind(source: str) -> str | None:
    try:
        compile_pattern(source)
    except PatternError as e:
        return e.kind
    return None


listed("e14_error_classes", "pattern string, kind string", _KINDS, lambda: [(p, _kind(p)) for p, _ in _KINDS], "Why patterns are refused.")
_SAME = [("^[ab]*$", "^(?:a|b)*$", True), ("^a+$", "^aa*$", True), ("^a*$", "^a+$", False), ("^(?:aa)*$", "^(?:aaaa)*(?:aa)?$", True), ("^(?!b)[ab]$", "^a$", True), ("a", "^[^a]*a", True)]
listed(
    "f10_equality", "n int, same boolean", [(i, w) for i, (*_, w) in enumerate(_SAME)], lambda: [(i, automata.pattern_language(a).same(automata.pattern_language(b))) for i, (a, b, _) in enumerate(_SAME)],
    "Whether two patterns have the same words.",
)
listed(
    "f11_range_sets", "n int, ranges string", [(0, "1-5"), (1, "1-2,4-5"), (2, "0-0,6-65535"), (3, "0-65535")],
    lambda: [(i, ",".join(f"{a}-{b}" for a, b in r)) for i, r in enumerate((patterns.merged([(3, 5), (1, 2)]), patterns.merged([(4, 5), (1, 2)]), patterns.complement(((1, 5),)), patterns.complement(())))],
    "Unions and complements of sets of units.",
)
listed("f08_password", "text string, ok boolean", [("", True), ("anything at all", True)], lambda: [(t, formats.matches_format("password", t)) for t in ("", "anything at all")], "The format password admits all strings.")

# parameters
_QUERIES_OF = [
    ({"schema": {"type": "string"}}, "p=a", '{"p":"a"}'), ({"schema": {"type": "string"}}, "p=", None), ({"schema": {"type": "string"}, "allowEmptyValue": True}, "p=", '{"p":""}'), ({"schema": {"type": "string"}}, "p=a&p=b", None),
    ({"schema": {"type": "array", "items": {"type": "string"}}, "explode": False}, "p=a,,b", None), ({"schema": {"type": "array", "items": {"type": "string"}}, "explode": False, "allowEmptyValue": True}, "p=a,,b", '{"p":["a","","b"]}'),
    ({"schema": {"type": "integer"}}, "p=1.0", '{"p":1}'), ({"schema": {"type": "integer"}}, "p=1.5", None), ({"schema": {"type": "boolean"}}, "p=true", '{"p":true}'), ({"schema": {"type": "boolean"}}, "p=TRUE", None), ({"required": True, "schema": {}}, "", None), ({"schema": {"type": "integer", "default": 7}}, "", '{"p":7}'),
]


def _decoded(parameter: dict, raw: str) -> str | None:
    own = compile_contract(_doc({"/v": {"get": {"operationId": "op", "parameters": [{"name": "p", "in": "query", **parameter}]}}}))["op"]
    try:
        return own.query.decode(raw)
    except ValueError:
        return None


listed("q10_empty_values", "n int, value string", [(i, w) for i, (*_, w) in enumerate(_QUERIES_OF)], lambda: [(i, _decoded(p, raw)) for i, (p, raw, _) in enumerate(_QUERIES_OF)], "Empty, repeated, missing and converted values of one query parameter.")
_OPEN = {"schema": {"type": "object", "additionalProperties": {"type": "string"}}}
_DEEP = {"style": "deepObject", "explode": True, "schema": {"type": "object", "properties": {"a": {"type": "string"}}}}
_SETS = [
    ([("p", {"schema": {}}), ("q", {"schema": {}})], True), ([("p", _OPEN), ("q", _OPEN)], False), ([("p", _OPEN), ("q", {"schema": {}})], True),
    ([("p", {"schema": {"type": "object", "properties": {"q": {}}, "additionalProperties": False}}), ("q", {"schema": {}})], False), ([("p", _DEEP), ("p[a]", {"schema": {}})], False),
]


def _parameters(ps: list) -> str:
    return _doc({"/v": {"get": {"operationId": "op", "parameters": [{"name": n, "in": "query", **p} for n, p in ps]}}})


listed("q08_collisions", "n int, admitted boolean", [(i, w) for i, (_, w) in enumerate(_SETS)], lambda: [(i, _error(compile_contract, _parameters(ps)) is None) for i, (ps, _) in enumerate(_SETS)], "Parameters that claim one name, and two open ones, exclude each other.")
listed(
    "q20_styles", "style string, shape string, explode boolean, admitted boolean",
    [
        (style, shape, explode, style == "form" or style != "deepObject" and shape != "scalar" and not explode or style == "deepObject" and shape == "object" and explode)
        for style in ("form", "spaceDelimited", "pipeDelimited", "deepObject") for shape in ("scalar", "array", "object") for explode in (False, True)
    ],
    lambda: [
        (style, shape, explode, _error(compile_contract, _parameters([("p", {"style": style, "explode": explode, "schema": schema})])) is None)
        for style in ("form", "spaceDelimited", "pipeDelimited", "deepObject")
        for shape, schema in (("scalar", {"type": "string"}), ("array", {"type": "array", "items": {"type": "string"}}), ("object", {"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": False}))
        for explode in (False, True)
    ],
    "The cells of style, shape and explode that query parameters may have.",
)

# generated cases, for a schema whose obligations fit on a page
_SMALL = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 1}}}
_OBLIGATIONS = [
    ("#", "type", "level:object", True, ""), ("#", "type", "fault:type", False, "type"), ("#", "required", "level:id", True, ""), ("#", "required", "fault:id", False, "required"),
    ("#", "additionalProperties", "level:valid", True, ""), ("#", "additionalProperties", "fault:additionalProperties", False, "additionalProperties"),
    ("#/id", "type", "level:number", True, ""), ("#/id", "type", "fault:type", False, "type"), ("#/id", "minimum", "level:valid", True, ""), ("#/id", "minimum", "fault:minimum", False, "minimum"),
]
_VALUES = ", ".join(f"({i}, {', '.join(map(_literal, r))})" for i, r in enumerate(_OBLIGATIONS))
_TABLE = f"(VALUES {_VALUES}) t(ord, template, rule, target, valid, keywords)"


def obligations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What generated rows have to cover, in order."""
    from ..generate.cases import obligation_table

    return obligation_table(spark, _body(_SMALL).body).select("ord", "template", "rule", "target")


def cases_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows, judged again: a valid one breaks no rule, a fault breaks its own alone."""
    from pyspark.sql import functions as F

    from ..generate.cases import generate_cases
    from ..operators import columns

    schema = _body(_SMALL).body
    words = F.array_join(F.transform(columns.body_errors(schema)(F.col("json")), lambda e: e["keyword"]), ",")
    return generate_cases(spark, schema).select("ord", "valid", words.alias("keywords"))


def coverage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which obligations generated rows cover."""
    from ..generate.cases import coverage, generate_cases

    schema = _body(_SMALL).body
    return coverage(spark, schema, generate_cases(spark, schema)).select("ord", "template", "rule", "target", "covered")


QUERIES |= {"g08_obligations": obligations_of, "g01_cases_agree": cases_judged, "g28_coverage": coverage_of}
SQL |= {
    "g08_obligations": f"SELECT ord, template, rule, target FROM {_TABLE}",
    "g01_cases_agree": f"SELECT ord, valid, keywords FROM {_TABLE}",
    "g28_coverage": f"SELECT ord, template, rule, target, true AS covered FROM {_TABLE}",
}
