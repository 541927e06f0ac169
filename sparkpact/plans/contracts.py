"""Contracts for the driver's tables, one operation a table."""

from __future__ import annotations

import functools

from ..contract import Contract, compile_contract

DOCUMENT = r"""
openapi: 3.0.3
info: {title: warehouse, version: "1"}
components:
  schemas:
    key: {type: integer, format: int64, minimum: 0}
    flag: {type: string, minLength: 1, maxLength: 1}
    lineitem:
      type: object
      required: [l_orderkey, l_linenumber, l_quantity, l_shipmode]
      properties:
        l_orderkey: {$ref: '#/components/schemas/key'}
        l_partkey: {$ref: '#/components/schemas/key'}
        l_linenumber: {type: integer, format: int32, maximum: 6}
        l_quantity: {type: number, minimum: 5, maximum: 45}
        l_discount: {type: number, minimum: 0, exclusiveMinimum: true, maximum: 0.1, exclusiveMaximum: true}
        l_tax: {type: number, multipleOf: 0.02}
        l_extendedprice: {type: integer}
        l_returnflag: {enum: [A, N, A]}
        l_linestatus: {allOf: [{$ref: '#/components/schemas/flag'}, {pattern: '^[OP]$'}]}
    order:
      type: object
      required: [o_orderstatus]
      properties:
        o_orderpriority: {type: string, enum: [1-URGENT, 2-HIGH, 3-MEDIUM, 2-HIGH]}
        o_orderstatus: {type: string, enum: [O, F]}
        o_totalprice: {type: number, multipleOf: 0.5}
    part:
      type: object
      properties:
        p_brand: {type: string, pattern: '^Brand#[1-2][0-9]?$'}
        p_name: {type: string, pattern: '\bpart\b'}
        p_retailprice: {type: number, format: float}
      anyOf:
        - {properties: {p_size: {maximum: 10}}}
        - {properties: {p_type: {enum: [PROMO]}}}
    customer:
      allOf:
        - {type: object, properties: {c_acctbal: {minimum: 0}}}
        - {type: object, properties: {c_mktsegment: {enum: [BUILDING, MACHINERY]}, c_acctbal: {maximum: 9000}}}
    embedding:
      type: object
      properties:
        embedding: {type: array, minItems: 64, maxItems: 64, items: {type: number, minimum: -0.3, maximum: 0.3}}
        label: {type: integer, nullable: true, maximum: 7}
    document:
      type: object
      properties:
        text: {type: string, minLength: 100, maxLength: 5000}
        lang: {type: string, pattern: '^(?!fr)[a-z]{2}$'}
        source: {type: string, pattern: '^src\d$'}
    edge:
      type: object
      properties:
        x: {type: number, format: double, minimum: 0, exclusiveMinimum: true, maximum: 1.0e+29, multipleOf: 0.05}
        n: {type: integer}
    props:
      type: object
      required: [k]
      additionalProperties: false
      maxProperties: 1
      properties: {k: {type: integer, minimum: 10, maximum: 89, multipleOf: 1}}
    turns:
      type: array
      minItems: 5
      items:
        type: object
        required: [role, turn]
        properties:
          role: {enum: [user, assistant]}
          turn: {type: integer, maximum: 5}
        additionalProperties: {type: string, maxLength: 400}
paths:
  /lineitem: {post: {operationId: lineitem, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/lineitem'}}}}}}
  /order: {post: {operationId: order, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/order'}}}}}}
  /part: {post: {operationId: part, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/part'}}}}}}
  /customer: {post: {operationId: customer, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/customer'}}}}}}
  /edge: {post: {operationId: edge, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/edge'}}}}}}
  /embedding: {post: {operationId: embedding, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/embedding'}}}}}}
  /document: {post: {operationId: document, requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/document'}}}}}}
  /props: {post: {operationId: props, requestBody: {required: true, content: {application/*: {schema: {$ref: '#/components/schemas/props'}}}}}}
  /turns: {post: {operationId: turns, requestBody: {content: {'*/*': {schema: {$ref: '#/components/schemas/turns'}}}}}}
  /{lang}/{id}:
    parameters:
      - {name: id, in: path, required: true, schema: {type: string}}
      - {name: lang, in: path, required: true, schema: {type: string, enum: [de, en, es]}}
    get:
      operationId: page
      parameters:
        - {name: id, in: path, required: true, schema: {type: integer, maximum: 150}}
        - {name: page, in: query, schema: {type: integer, default: 1, maximum: 5}}
        - {name: ref, in: query, schema: {type: string}}
    put:
      operationId: openPage
      parameters:
        - {name: ref, in: query, schema: {type: string}}
        - name: rest
          in: query
          schema: {type: object, properties: {page: {type: integer}}, additionalProperties: {type: string}}
"""


@functools.lru_cache(maxsize=1)
def warehouse() -> Contract:
    return compile_contract(DOCUMENT)
