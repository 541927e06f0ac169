import json

import pytest

from sparkpact.contract import Contract, compile_contract
from sparkpact.operators.evaluate import check_text
from sparkpact.plans.wire import WireError
from sparkpact.sources.document import ContractError


def body_contract(schema, required=False, **more):
    doc = {"openapi": "3.0.3", "info": {}, "paths": {"/a": {"post": {"operationId": "op", "requestBody": {"required": required, "content": {"application/json": {"schema": schema}}}}}}}
    return compile_contract(json.dumps(doc | more))


def keywords(schema, text, **more):
    return [v.keyword for v in body_contract(schema, **more)["op"].errors(text)]


KEYWORDS = [
    ({"type": "string"}, '"x"', "1", "type"),
    ({"type": "integer"}, "1.0", "1.5", "type"),
    ({"enum": [1, {"a": [1]}]}, '{"a":[1e0]}', "2", "enum"),
    ({"minimum": 1}, "1", "0.9", "minimum"),
    ({"minimum": 1, "exclusiveMinimum": True}, "1.01", "1", "exclusiveMinimum"),
    ({"maximum": 1}, "1", "1.1", "maximum"),
    ({"maximum": 1, "exclusiveMaximum": True}, "0.9", "1", "exclusiveMaximum"),
    ({"multipleOf": 0.1}, "0.3", "0.35", "multipleOf"),
    ({"format": "int32"}, "2147483647", "2147483648", "format"),
    ({"format": "int64"}, "1e3", "1.5", "format"),
    ({"format": "float"}, "1e-400", "3.5e38", "format"),
    ({"format": "double"}, "1e308", "1e400", "format"),
    ({"minLength": 2}, '"😀a"', '"😀"', "minLength"),
    ({"maxLength": 1}, '"😀"', '"ab"', "maxLength"),
    ({"pattern": "^a$"}, '"a"', '"b"', "pattern"),
    ({"format": "date"}, '"2024-02-29"', '"2023-02-29"', "format"),
    ({"items": {}, "minItems": 1}, "[1]", "[]", "minItems"),
    ({"items": {}, "maxItems": 1}, "[1]", "[1,2]", "maxItems"),
    ({"items": {"type": "string"}}, '["a"]', "[1]", "type"),
    ({"minProperties": 1}, '{"a":1}', "{}", "minProperties"),
    ({"maxProperties": 1}, "{}", '{"a":1,"b":1}', "maxProperties"),
    ({"required": ["a"]}, '{"a":null}', "{}", "required"),
    ({"properties": {"a": {"type": "string"}}}, "{}", '{"a":1}', "type"),
    ({"additionalProperties": {"type": "string"}}, '{"a":"b"}', '{"a":1}', "type"),
    ({"additionalProperties": False, "properties": {"a": {}}}, '{"a":1}', '{"b":1}', "additionalProperties"),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, "2", "4", "maximum"),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "5", "4", "anyOf"),
]


@pytest.mark.parametrize("shape", ["root", "nested", "allOf"])
@pytest.mark.parametrize(("schema", "good", "bad", "keyword"), KEYWORDS)
def test_keywords(schema, good, bad, keyword, shape):
    if shape == "nested":
        schema, good, bad = {"properties": {"p": schema}}, f'{{"p":{good}}}', f'{{"p":{bad}}}'
    if shape == "allOf":
        schema = {"allOf": [schema]}
    assert keywords(schema, good) == []
    assert keywords(schema, bad) == [keyword]


@pytest.mark.parametrize(
    ("schema", "text", "want"),
    [
        ({"type": "string", "nullable": True}, "null", []),
        ({"type": "string"}, "null", ["type"]),
        ({"nullable": True}, "null", []),
        ({"minLength": 3}, "null", []),
        ({"type": "string", "nullable": True, "enum": ["a"]}, "null", ["enum"]),
        ({"allOf": [{"type": "string", "nullable": True}, {"type": "string"}]}, "null", ["type"]),
        ({"properties": {"a": {"type": "string", "readOnly": True}}, "required": ["a"]}, "{}", []),
        ({"allOf": [{"properties": {"a": {}}, "additionalProperties": False}, {"properties": {"b": {}}}]}, '{"a":1,"b":2}', ["additionalProperties"]),
    ],
)
def test_nulls_and_composition(schema, text, want):
    assert keywords(schema, text) == want


def test_absent_bodies():
    assert keywords({}, "", required=True) == ["requestBody"]
    assert keywords({}, None) == []
    assert keywords({}, " ") == ["body"]
    assert keywords({}, '{"a":1,"a":2}') == ["body"]


def test_order_and_text():
    schema = {"type": "object", "required": ["z", "b"], "properties": {"a": {"type": "string", "minLength": 2, "pattern": "x"}}, "maxProperties": 0}
    found = body_contract(schema)["op"].errors('{"a":"q","c/d":1}')
    assert [(v.instance_pointer, v.keyword) for v in found] == [("#", "maxProperties"), ("#/b", "required"), ("#/z", "required"), ("#/a", "minLength"), ("#/a", "pattern")]
    assert str(found[1]).endswith("keyword required: required property is absent")
    assert str(found[3]) == "instance #/a schema #/paths/~1a/post/requestBody/content/application~1json/schema/properties/a keyword minLength: length 1 is less than 2"


def test_any_of_branches():
    schema = body_contract({"anyOf": [{"type": "string"}, {"type": "boolean"}]})["op"].body
    assert [v.keyword for v in check_text(schema, "1")] == ["anyOf"]
    assert [v.keyword for v in check_text(schema, "1", keep_branches=True)] == ["anyOf", "type", "type"]


def test_doubling_graph_is_linear():
    schemas = {"s0": {"type": "string"}}
    for i in range(1, 25):
        ref = {"$ref": f"#/components/schemas/s{i - 1}"}
        schemas[f"s{i}"] = {"anyOf": [ref, ref]}
    assert keywords({"$ref": "#/components/schemas/s24"}, "1", components={"schemas": schemas}) == ["anyOf"]


@pytest.mark.parametrize(
    "schema",
    [
        {"oneOf": [{}]}, {"not": {}}, {"uniqueItems": True}, {"discriminator": {"propertyName": "a"}}, {"foo": 1}, {"type": "null"}, {"type": "array"},
        {"enum": []}, {"required": []}, {"required": ["a", "a"]}, {"multipleOf": 0}, {"minLength": -1}, {"minItems": 1.5}, {"pattern": "("}, {"format": "hostname"},
        {"type": "string", "format": "int32"}, {"type": "integer", "format": "float"}, {"allOf": []}, {"anyOf": {}}, {"minimum": "1"}, {"exclusiveMinimum": 1},
        {"default": 1, "type": "string"}, {"$ref": "#/nowhere"}, {"$ref": "other.yaml#/a"}, {"properties": []}, {"externalDocs": {}}, {"xml": {"namespace": "x"}},
        {"properties": {"a": {"readOnly": True, "writeOnly": True}}}, {"$ref": "#/paths/~1a/post/requestBody/content/application~1json/schema"},
    ],
)
def test_refused_schemas(schema):
    with pytest.raises(ContractError):
        body_contract(schema)


def test_recursion():
    with pytest.raises(ContractError):
        body_contract({"$ref": "#/components/schemas/a"}, components={"schemas": {"a": {"properties": {"b": {"$ref": "#/components/schemas/a"}}}}})


@pytest.mark.parametrize(
    "text",
    [
        "[]", "{", '{"openapi":"3.1.0","paths":{}}', '{"openapi":"3.0","paths":{}}', '{"openapi":"3.0.0"}', '{"openapi":"3.0.0","openapi":"3.0.0","paths":{}}',
        '{"openapi":"3.0.0","paths":{"a":{}}}', '{"openapi":"3.0.0","paths":{"/{a}/x":{},"/{b}/x":{}}}', '{"openapi":"3.0.0","paths":{"/{a}{b}":{}}}',
        '{"openapi":"3.0.0","paths":{"/a":{"foo":{}}}}', '{"openapi":"3.0.0","paths":{"/a":{"get":{}}}}',
        '{"openapi":"3.0.0","paths":{"/a":{"get":{"operationId":"x"},"put":{"operationId":"x"}}}}', '{"openapi":"3.0.0","paths":{"/{a}":{"get":{"operationId":"x"}}}}',
    ],
)
def test_refused_documents(text):
    with pytest.raises(ContractError):
        compile_contract(text)


def test_media_types():
    doc = {"openapi": "3.0.3", "paths": {"/a": {"post": {"operationId": "op", "requestBody": {"content": {"*/*": {"schema": {"type": "string"}}, "Application/JSON; charset=utf-8": {"schema": {"type": "integer"}}}}}}}}
    assert compile_contract(json.dumps(doc))["op"].body.type == "integer"
    doc["paths"]["/a"]["post"]["requestBody"]["content"] = {"text/plain": {}}
    assert compile_contract(json.dumps(doc))["op"].body is None
    doc["paths"]["/a"]["post"]["requestBody"]["content"] = {"application/json": {}}
    assert compile_contract(json.dumps(doc))["op"].errors("[1]") == []


def test_yaml_keeps_numbers():
    text = 'openapi: 3.0.3\npaths: {/a: {post: {operationId: op, requestBody: {content: {application/json: {schema: {maximum: 12345678901234567890.125, enum: [0x10, 1.50, "1", yes, null, ~]}}}}}}}\n'
    body = compile_contract(text)["op"].body
    assert body.maximum.lexeme == "12345678901234567890.125"
    assert list(body.members) == ["16", "1.5", '"1"', "true", "null"]


def query(parameters, raw):
    parameters = parameters if isinstance(parameters, list) else [parameters]
    doc = {"openapi": "3.0.3", "paths": {"/a": {"get": {"operationId": "op", "parameters": parameters}}}}
    contract = compile_contract(json.dumps(doc))
    again = Contract.from_json(contract.to_json())
    assert again.to_json() == contract.to_json()
    got = contract["op"].query.decode(raw)
    assert again["op"].query.decode(raw) == got
    return got


def q(schema, **more):
    return {"name": "p", "in": "query", "schema": schema, **more}


S, I, B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
POINT = {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "number"}}}


@pytest.mark.parametrize(
    ("parameter", "raw", "want"),
    [
        (q(S), "p=red%20shoes+x", '{"p":"red shoes x"}'),
        (q(B), "p=false", '{"p":false}'),
        (q(I), "p=1.0", '{"p":1}'),
        (q({"type": "number"}), "p=9007199254740993.25", '{"p":9007199254740993.25}'),
        (q({"type": "array", "items": S}), "p=a&p=b,c", '{"p":["a","b,c"]}'),
        (q({"type": "array", "items": S}, explode=False), "p=a%2Cb,c", '{"p":["a,b","c"]}'),
        (q({"type": "array", "items": I}, style="spaceDelimited", explode=False), "p=1+2%203", '{"p":[1,2,3]}'),
        (q({"type": "array", "items": B}, style="pipeDelimited", explode=False), "p=true%7Cfalse", '{"p":[true,false]}'),
        (q(POINT, explode=False), "p=x,1.5,y,2", '{"p":{"x":1.5,"y":2}}'),
        (q(POINT), "y=2&x=1.5&z=q", '{"p":{"x":1.5,"y":2,"z":"q"}}'),
        (q(POINT, style="deepObject", explode=True), "p%5By%5D=2&p%5Bz%5D=1", '{"p":{"y":2,"z":"1"}}'),
        (q({"type": "object", "properties": {"t": {"type": "array", "items": S}}}, style="deepObject", explode=True), "p%5Bt%5D=a&p%5Bt%5D=b", '{"p":{"t":["a","b"]}}'),
        ({"name": "p", "in": "query", "content": {"application/json": {"schema": {"type": "object"}}}}, "p=%7B%22a%22%3A%5B1%5D%7D", '{"p":{"a":[1]}}'),
        (q({"anyOf": [I, S]}), "p=x", '{"p":"x"}'),
        (q({"anyOf": [I, S]}), "p=7", '{"p":7}'),
        (q({"type": "integer", "default": 3}), "other=1", '{"p":3}'),
        (q(S, allowEmptyValue=True), "p=", '{"p":""}'),
        (q(S), "", "{}"),
        (q({"enum": [1, 2]}), "p=2", '{"p":2}'),
    ],
)
def test_query(parameter, raw, want):
    assert query(parameter, raw) == want


@pytest.mark.parametrize(
    ("parameter", "raw"),
    [
        (q(I), "p=a"), (q(I), "p=1.5"), (q(B), "p=TRUE"), (q(S), "p="), (q(S, required=True), "z=1"), (q(S), "p=%zz"), (q(S), "p=%ff"), (q(S), "z[]=1"),
        (q(S), "p=1&p=2"), (q({"type": "integer", "maximum": 3}), "p=4"), (q(POINT, explode=False), "p=x,1,y"), (q(POINT, explode=False), "p=x,1,x,2"),
        (q(POINT, style="deepObject", explode=True), "p%5bx%5d=1"), (q(POINT, style="deepObject", explode=True), "p%5Bx%5D%5By%5D=1"), (q({"type": "array", "items": I}, style="pipeDelimited", explode=False), "p=1|2"),
        (q({**POINT, "additionalProperties": False}, style="deepObject", explode=True), "p%5Bz%5D=1"), (q({"type": "integer", "default": 9, "maximum": 3}), ""),
    ],
)
def test_query_refused(parameter, raw):
    with pytest.raises(WireError):
        query(parameter, raw)


@pytest.mark.parametrize(
    "parameters",
    [
        [q(S, style="spaceDelimited")], [q({"type": "array", "items": S}, style="spaceDelimited", explode=True)], [q(POINT, style="deepObject", explode=False)],
        [q({"type": "array", "items": {"type": "array", "items": S}})], [q(POINT), {"name": "x", "in": "query", "schema": S}],
        [q(POINT), {"name": "r", "in": "query", "schema": {"type": "object"}}], [q(S), q(S)], [{"name": "p", "in": "query"}],
        [{"name": "p", "in": "query", "content": {"text/plain": {}}}], [{"name": "p", "in": "cookie", "schema": S, "style": "simple"}],
    ],
)
def test_query_wires_refused(parameters):
    with pytest.raises(ContractError):
        query(parameters, "")


def path(style, explode, schema, raw):
    p = {"name": "c", "in": "path", "required": True, "style": style, "explode": explode, "schema": schema}
    doc = {"openapi": "3.0.3", "paths": {"/v/{c}": {"get": {"operationId": "op", "parameters": [p]}}}}
    contract = compile_contract(json.dumps(doc))
    got = contract["op"].path.decode(raw)
    assert Contract.from_json(contract.to_json())["op"].path.decode(raw) == got
    return got


A, O = {"type": "array", "items": S}, {"type": "object", "properties": {"R": I, "G": I}}


@pytest.mark.parametrize(
    ("style", "explode", "schema", "raw", "want"),
    [
        ("simple", False, S, "blue", '"blue"'), ("simple", False, A, "a,b", '["a","b"]'), ("simple", True, A, "a,b", '["a","b"]'), ("simple", False, O, "R,1,G,2", '{"R":1,"G":2}'),
        ("simple", True, O, "R=1,G=2", '{"R":1,"G":2}'), ("label", False, S, ".blue", '"blue"'), ("label", False, A, ".a,b", '["a","b"]'), ("label", True, A, ".a.b", '["a","b"]'),
        ("label", False, O, ".R,1", '{"R":1}'), ("label", True, O, ".R=1.G=2", '{"R":1,"G":2}'), ("matrix", False, S, ";c=blue", '"blue"'), ("matrix", False, A, ";c=a,b", '["a","b"]'),
        ("matrix", True, A, ";c=a;c=b", '["a","b"]'), ("matrix", False, O, ";c=R,1", '{"R":1}'), ("matrix", True, O, ";R=1;G=2", '{"R":1,"G":2}'),
        ("simple", False, A, "", "[]"), ("simple", False, O, "", "{}"), ("simple", False, S, "", '""'), ("label", False, A, ".", "[]"), ("matrix", False, S, ";c", '""'), ("matrix", True, A, ";c", "[]"),
        ("simple", False, A, "a%2Cb,c+d", '["a,b","c+d"]'), ("simple", False, {"anyOf": [I, S]}, "x", '"x"'),
    ],
)
def test_path(style, explode, schema, raw, want):
    assert path(style, explode, schema, f"/v/{raw}") == f'{{"c":{want}}}'


@pytest.mark.parametrize(
    ("style", "schema", "raw"),
    [("simple", I, "/v/a"), ("label", S, "/v/blue"), ("matrix", S, "/v/;d=blue"), ("simple", S, "/v/a/b"), ("simple", S, "/w/a"), ("simple", O, "/v/R,1,G"), ("simple", O, "/v/R,1,R,2"), ("simple", S, "/v/%ff")],
)
def test_path_refused(style, schema, raw):
    with pytest.raises(WireError):
        path(style, False, schema, raw)


@pytest.mark.parametrize("schema", [{}, {"type": "string", "nullable": True}, {"type": "array", "items": {"type": "object"}}])
def test_path_wires_refused(schema):
    with pytest.raises(ContractError):
        path("simple", False, schema, "/v/a")


def test_path_order_is_the_template_s():
    ps = [{"name": n, "in": "path", "required": True, "schema": S} for n in ("b", "a")]
    doc = {"openapi": "3.0.3", "paths": {"/{a}-{b}": {"get": {"operationId": "op", "parameters": ps}}}}
    assert compile_contract(json.dumps(doc))["op"].path.decode("/x-y-z") == '{"a":"x","b":"y-z"}'


@pytest.mark.parametrize("change", [{"required": ["b", "a"]}, {"nullable": True, "type": ""}, {"multiple_of": {"number": "0"}}, {"string_format": "host"}, {"enum": ["1.0"]}, {"min_items": {"number": "-1"}}])
def test_edited_contract_is_refused(change):
    data = json.loads(body_contract({"type": "object", "required": ["a"]}).to_json())
    data["schemas"][0] |= change
    with pytest.raises(ContractError):
        Contract.from_json(json.dumps(data))


def document(text="", **more):
    return json.loads(text) if text else {"openapi": "3.0.3", "paths": {}, **more}


def operation(**op):
    return document(paths={"/things": {"post": {"operationId": "things", **op}}})


BAD = {"uniqueItems": False}
JSON_BAD = {"application/json": {"schema": BAD}}


@pytest.mark.parametrize(
    ("doc", "pointer"),
    [
        (document(components={"schemas": {"a/b~c": BAD}}), "#/components/schemas/a~1b~0c/uniqueItems"),
        (operation(responses={"200": {"description": "ok", "content": JSON_BAD}}), "#/paths/~1things/post/responses/200/content/application~1json/schema/uniqueItems"),
        (
            operation(callbacks={"event": {"{$request.body#/url}": {"post": {"operationId": "callback", "requestBody": {"content": JSON_BAD}}}}}),
            "#/paths/~1things/post/callbacks/event/{$request.body#~1url}/post/requestBody/content/application~1json/schema/uniqueItems",
        ),
        (document(components={"parameters": {"p": {"name": "p", "in": "query", "schema": BAD}}}), "#/components/parameters/p/schema/uniqueItems"),
        (document(components={"headers": {"h": {"content": JSON_BAD}}}), "#/components/headers/h/content/application~1json/schema/uniqueItems"),
        (operation(responses={"200": {"headers": {"h": {"schema": BAD}}}}), "#/paths/~1things/post/responses/200/headers/h/schema/uniqueItems"),
        (operation(requestBody={"content": {"multipart/form-data": {"encoding": {"f": {"headers": {"h": {"schema": BAD}}}}}}}), "encoding/f/headers/h/schema/uniqueItems"),
        (document(components={"schemas": {"a": {"oneOf": [{"not": BAD}]}}}), "#/components/schemas/a/oneOf/0/not/uniqueItems"),
        (document(components={"schemas": {"a": {"discriminator": {}, "oneOf": []}}}), "#/components/schemas/a/oneOf"),
        (document(components={"schemas": {"a": {"properties": {"b": {"discriminator": {}}}}}}), "#/components/schemas/a/properties/b/discriminator"),
        (document(components={"schemas": {"a": {"$ref": "other.yaml#/a"}}}), "#/components/schemas/a"),
        (document(components={"schemas": {"a": {"items": {"$ref": "#/components/schemas/a"}}}}), "#/components/schemas/a"),
        (document(components={"schemas": {"a": {"$ref": "#/components/schemas/b"}, "b": {"$ref": "#/components/schemas/a"}}}), "cyclic"),
        (document(components={"schemas": {"a": []}}), "#/components/schemas/a"),
        (document(components={"callbacks": {"c": {"{$url}": {"fetch": {}}}}}), "#/components/callbacks/c/{$url}/fetch"),
        (document(components={"callbacks": {"c": {"{$url}": {"$ref": "#/paths/~1a", "get": {}}}}, "schemas": {}}), "#/components/callbacks/c/{$url}/$ref"),
        (operation(callbacks=[]), "#/paths/~1things/post/callbacks"),
        (operation(callbacks={"c": {"x": {"get": []}}}), "#/paths/~1things/post/callbacks/c/x/get"),
        (document(paths={"/a": {"parameters": {}}}), "#/paths/~1a/parameters"),
        (document(components={"links": {"l": {"$ref": "#/components/links/m"}}}), "#/components/links/m"),
        (document(components={"examples": {"l": {"$ref": "#/components/examples/m"}}}), "#/components/examples/m"),
        (document(components={"securitySchemes": {"l": {"$ref": "#/components/securitySchemes/m"}}}), "#/components/securitySchemes/m"),
    ],
)
def test_excluded_anywhere(doc, pointer):
    with pytest.raises(ContractError) as e:
        compile_contract(json.dumps(doc))
    assert pointer in str(e.value)


@pytest.mark.parametrize("kind", ["schemas", "parameters", "requestBodies", "responses", "headers", "callbacks"])
def test_dangling_references_anywhere(kind):
    with pytest.raises(ContractError, match=f"#/components/{kind}/Missing"):
        compile_contract(json.dumps(document(components={kind: {"Broken": {"$ref": f"#/components/{kind}/Missing"}}})))
    with pytest.raises(ContractError, match="#/components/schemas/Missing"):
        compile_contract(json.dumps(document(components={"responses": {"b": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Missing"}}}}}})))


def test_admitted_documents():
    chain = {f"r{i}": {"$ref": f"#/components/responses/r{i + 1}"} for i in range(64)} | {"r64": {"description": "last"}}
    deep = {}
    for _ in range(2000):
        deep = {"items": deep}
    parts = {
        "schemas": {"a": {"properties": {"uniqueItems": {}, "discriminator": {}}, "example": {"uniqueItems": True}, "default": {"$ref": "x"}}, "deep": deep},
        "responses": chain, "examples": {"e": {"value": {"uniqueItems": True, "$ref": "x"}}}, "x-own": {"uniqueItems": True},
        "callbacks": {"c": {"x-note": 1, "{$url}": {"$ref": "#/paths/~1a"}}},
    }
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)  # json.dumps recurs, the walk does not
    try:
        text = json.dumps(document(paths={"/a": {"get": {"operationId": "a-b/c_d", "responses": {"x-a": 1}}}}, components=parts))
    finally:
        sys.setrecursionlimit(limit)
    assert compile_contract(text).identifiers() == {"a_0b_1c__d": "a-b/c_d"}


def test_identifiers():
    from sparkpact.sources.document import identifier

    names = ["a_b", "a-b", "a/b", "ab", "a0b", "class", "a-0b", "x_class", "a1/b", "a/1b"]
    assert len({identifier(n) for n in names}) == len(names) and all(identifier(n).isidentifier() for n in names)
    for bad in ("", "1a", "a__b", "a-", "a.b", "é"):
        with pytest.raises(ContractError):
            identifier(bad)
