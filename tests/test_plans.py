import json

import pytest
from pyspark.sql import functions as F

from sparkpact.contract import Contract, compile_contract
from sparkpact.generate.cases import build, coverage, generate_cases, obligations
from sparkpact.operators import columns, nodes, typed
from sparkpact.plans import queries
from sparkpact.plans.contracts import warehouse

from .oracle import agree


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        agree(df, queries.SQL[name], sf_dir)
    else:
        assert df.count() > 0


SCHEMA = {
    "type": "object",
    "required": ["i", "gone"],
    "minProperties": 2,
    "maxProperties": 3,
    "properties": {
        "i": {"type": "integer", "minimum": 2, "maximum": 4, "enum": [1, 2, 3]},
        "d": {"type": "number", "multipleOf": 0.1, "maximum": 0.5, "exclusiveMaximum": True},
        "s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a", "format": "email"},
        "b": {"type": "boolean", "enum": [True]},
        "x": {"anyOf": [{"maximum": 1}, {"minimum": 9}]},
    },
}


def contract(schema):
    doc = {"openapi": "3.0.3", "paths": {"/a": {"post": {"operationId": "op", "requestBody": {"content": {"application/json": {"schema": schema}}}}}}}
    return compile_contract(json.dumps(doc))["op"]


def test_typed_and_node_plans_agree(spark):
    rows = [(1, 1, 0.3, "ab", True, 5), (2, 5, 0.5, "b", False, 9), (3, None, -0.05, None, None, None), (4, None, None, None, None, None), (5, 3, 0.1, "a@b", None, None)]
    df = spark.createDataFrame(rows, "k int, i int, d double, s string, b boolean, x int")
    r = contract(SCHEMA)
    by_type = {(v.k, v.pointer, v.keyword) for v in r.validate_table(df, ["k"]).collect()}
    text = df.select("k", F.to_json(F.struct("i", "d", "s", "b", "x")).alias("j"))
    by_node = {(v.k, v.instance_pointer, v.keyword) for v in r.validate(text, "j").select("k", F.inline("errors")).collect()}
    assert by_type == by_node
    assert (1, "#/x", "anyOf") in by_type and (3, "#/gone", "required") in by_type and (4, "#", "minProperties") in by_type
    found = {(c.pointer, c.keyword): c.violations for c in typed.violation_counts(df, r.body).collect()}
    assert found["#/gone", "required"] == 5


def test_null_as_null(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "k int, i int")
    schema = contract({"type": "object", "required": ["i"], "properties": {"i": {"type": "integer"}}}).body
    assert [(v.k, v.keyword) for v in typed.table_violations(df, schema, ["k"]).collect()] == [(1, "required")]
    assert [(v.k, v.keyword) for v in typed.table_violations(df, schema, ["k"], null_as="null").collect()] == [(1, "type")]


def test_rule_join_agrees_with_evaluation(spark):
    schema = contract(
        {
            "type": "object",
            "required": ["a", "q/r"],
            "additionalProperties": False,
            "properties": {
                "a": {"type": "array", "minItems": 2, "items": {"type": "integer", "minimum": -1.5, "exclusiveMinimum": True, "maximum": 1e30}},
                "0": {"type": "object", "nullable": True, "maxProperties": 1, "properties": {"s": {"enum": ["x<", 1.0, None]}}},
                "q/r": {"type": "string", "maxLength": 2},
            },
        }
    ).body
    texts = [
        '{"a":[1,2],"q/r":"ab"}', '{"a":[-1.5,-2,2e30,1.5]}', '{"0":{"s":"x<","t":1}}', '{"0":{"s":1},"a":"x"}', '{"0":{"s":2},"q/r":"abc","z":1}', "[]", "null", '{"a":[-1.4999,0],"0":null}', "{",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    joined = nodes.violations(nodes.node_table(df, "j", ["k"]), nodes.rule_table(spark, schema), ["k"])
    direct = df.select("k", F.inline(columns.body_errors(schema)(F.col("j")))).filter("keyword <> 'body'")
    got = sorted(tuple(r) for r in joined.collect())
    assert got == sorted(tuple(r) for r in direct.select("k", "instance_pointer", "schema_pointer", "keyword").collect())


def test_plans_prune_columns(spark, sf_dir):
    df = typed.table_violations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), warehouse()["lineitem"].body, ["l_orderkey"], ["l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_saved_contract(spark, tmp_path):
    warehouse().save(spark, str(tmp_path / "c"))
    again = Contract.load(spark, str(tmp_path / "c"))
    assert again.to_json() == warehouse().to_json()
    assert again["page"].query.decode("page=2") == '{"page":2}'


GENERATED = {
    "type": "object",
    "required": ["n", "s"],
    "additionalProperties": False,
    "properties": {
        "n": {"type": "integer", "minimum": 1, "maximum": 5},
        "s": {"type": "string", "pattern": "^(?!b)[a-c]{2,4}$"},
        "l": {"type": "array", "items": {"type": "boolean"}, "minItems": 1, "maxItems": 2},
        "e": {"type": "string", "nullable": True, "enum": ["p", "q", None]},
        "u": {"anyOf": [{"type": "integer"}, {"type": "string", "minLength": 1}]},
    },
}


def test_build_is_right_and_repeatable():
    r = contract(GENERATED)
    runs = []
    for _ in range(2):
        rows = []
        report = build(r.body, 20000, rows.append)
        runs.append((rows, report.covered))
    assert runs[0] == runs[1]
    rows, report_covered = runs[0]
    assert all((not r.errors(c.json)) == c.valid for c in rows)
    assert [c.valid for c in rows] == sorted((c.valid for c in rows), reverse=True)
    assert all(len({(v.instance_pointer, v.keyword) for v in r.errors(c.json)}) == 1 for c in rows if not c.valid)
    assert len(report_covered) >= 0.8 * len(obligations(r.body))


def test_build_budget():
    r = contract(GENERATED)
    rows = []
    assert build(r.body, 0, rows.append).stop_reason == "max_steps_reached" and rows == []
    assert build(r.body, 3, rows.append).stop_reason == "max_steps_reached"
    assert build(contract({"type": "boolean"}).body, 100, rows.append).stop_reason == "space_exhausted"

    def fail(_):
        raise RuntimeError("enough")

    with pytest.raises(RuntimeError):
        build(r.body, 100, fail)


def test_generate_on_spark(spark):
    r = contract(GENERATED)
    cases = generate_cases(spark, r.body).cache()
    assert all((not r.errors(c.json)) == c.valid for c in cases.collect())
    table = coverage(spark, r.body, cases)
    assert table.count() == len(obligations(r.body)) and table.filter("covered").count() == cases.count()


def built(schema, steps=60000):
    r = contract(schema)
    rows = []
    report = build(r.body, steps, rows.append)
    assert all((not r.errors(c.json)) == c.valid for c in rows)
    return r, report, [c.json for c in rows if c.valid], [c.json for c in rows if not c.valid]


def test_strings_of_joint_patterns_formats_and_lengths():
    """Words that no sample has come from the product of all conjuncts' languages."""
    schema = {"allOf": [{"type": "string", "pattern": "^[a-f]+$"}, {"pattern": "^(?:ab)+c"}, {"pattern": "d{3}$", "minLength": 12, "maxLength": 14}]}
    _, report, good, bad = built(schema)
    assert {o.target for o in report.uncovered} == set() and report.stop_reason == "space_exhausted"
    assert good and any(len(x) == 14 for x in good) and len(bad) >= 5
    _, report, good, _ = built({"type": "string", "format": "date", "pattern": "^19[0-9]{2}-0[1-3]"})
    assert good and report.uncovered == []


def test_long_strings():
    _, report, good, bad = built({"type": "string", "pattern": "^(?:abc)*$", "minLength": 5000, "maxLength": 6000})
    assert report.uncovered == [] and len(good[0]) > 5000 and 6003 in {len(x) - 2 for x in bad} and min(len(x) for x in bad) < 5000
    _, report, _, _ = built({"type": "string", "maxLength": 10**9})
    assert report.stop_reason == "limits_reached" and [o.target for o in report.uncovered] == ["fault:maxLength"]


def test_faults_that_cannot_stand_alone_stay_uncovered():
    _, report, _, _ = built({"type": "string", "pattern": "^a{3}$", "maxLength": 5})
    assert [o.target for o in report.uncovered] == ["fault:maxLength"] and report.stop_reason == "space_exhausted"
    _, report, _, _ = built({"type": "integer", "minimum": 3, "multipleOf": 2, "enum": [4, 6]})
    assert {o.target for o in report.uncovered} == {"fault:type", "fault:minimum", "fault:multipleOf"}


def test_order_of_obligations():
    r = contract({"allOf": [{"type": "string", "format": "date", "maxLength": 10, "minLength": 1}] * 1 + [{}] * 10, "type": "string", "nullable": True})
    found = obligations(r.body)
    own = [o for o in found if o.pointer.endswith("/allOf/0")]
    assert [o.rule for o in own if o.target.startswith("fault")] == ["type", "minLength", "maxLength", "format"]
    at = [o.pointer.rpartition("/")[2] for o in found if "/allOf/" in o.pointer]
    assert at == sorted(at, key=int)
    number = contract({"type": "number", "format": "float", "maximum": 1, "multipleOf": 0.5}).body
    assert [o.rule for o in obligations(number) if o.target.startswith("fault")] == ["type", "maximum", "multipleOf", "format"]


def test_faults_of_alternatives():
    """A value that no alternative admits, while all else holds: by languages, and beside the bounds of numbers."""
    words = {"type": "string", "pattern": "^[a-d]{4}$", "anyOf": [{"pattern": "^a"}, {"pattern": "b$"}, {"enum": ["cccc", "dddd"]}, {"minLength": 9}]}
    r, report, good, bad = built(words)
    assert not [o for o in report.uncovered if o.rule == "anyOf"]
    assert any([v.keyword for v in r.errors(x)] == ["anyOf"] for x in bad)
    _, report, _, _ = built({"type": "integer", "minimum": 0, "maximum": 100, "anyOf": [{"maximum": 40}, {"minimum": 42, "maximum": 90}, {"minimum": 92}]})
    assert not [o for o in report.uncovered if o.target == "fault:anyOf"]
    _, report, _, _ = built({"type": "string", "anyOf": [{"pattern": "^a"}, {"pattern": "^[^a]"}, {"maxLength": 0}]})
    assert "fault:anyOf" in [o.target for o in report.uncovered]  # there is no such string


def test_admission_of_generated_bodies():
    from sparkpact.contract import compile_contract
    from sparkpact.generate.cases import body_schema
    from sparkpact.sources.document import ContractError

    def doc(**content):
        return json.dumps({"openapi": "3.0.3", "paths": {"/a": {"post": {"operationId": "op", "requestBody": {"content": {k.replace("_", "/"): v for k, v in content.items()}}}}}})

    assert body_schema(doc(application_json={"schema": {"type": "boolean"}}), "op").type == "boolean"
    assert body_schema(doc(**{"application_*": {"schema": {}}, "application_json": {"schema": {"type": "string"}}}), "op").type == "string"
    missing = doc(application_json={})
    assert compile_contract(missing)["op"].errors("1") == []  # validation takes any value
    for bad in (missing, doc(text_plain={"schema": {}}), doc(**{"application_json": {"schema": {}}, "application_json;a=b": {"schema": {}}})):
        with pytest.raises(ContractError):
            body_schema(bad, "op")
    with pytest.raises(ContractError):
        body_schema(missing, "other")


def test_seeded_frontier():
    from sparkpact.generate.witnesses import frontier

    first, again, other = (list(frontier(s)) for s in (7, 7, 8))
    assert first == again != other and len(set(first)) > 100
    assert max(len(n.digits) for n in first) == 4 and {len(n.digits) for n in first[:6]} == {1}
