"""Column functions over raw JSON, queries and paths: one pass in Arrow batches, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.exact import JSONError, Num, canonical, digest, flatten, parse
from ..plans.schema import Schema
from .evaluate import check_text

ERROR = "struct<instance_pointer:string,schema_pointer:string,keyword:string,reason:string>"
#: A value's place; order is that of evaluation. names: an object's members. text is a string's own text, others' canonical text.
NODE = (
    "struct<ord:int,template:string,pointer:string,parent:string,name:string,idx:int,kind:string,size:int,names:array<string>,text:string,"
    "num_neg:boolean,num_mag:bigint,num_digits:string,num_exp:bigint>"
)
_ERRORS = pa.list_(pa.struct([(n, pa.string()) for n in ("instance_pointer", "schema_pointer", "keyword", "reason")]))
_DECODED = pa.struct([("value", pa.string()), ("error", pa.string())])
_NODES = pa.struct(
    [
        ("error", pa.string()),
        ("canonical", pa.string()),
        ("hash", pa.string()),
        (
            "nodes",
            pa.list_(
                pa.struct(
                    [
                        ("ord", pa.int32()), ("template", pa.string()), ("pointer", pa.string()), ("parent", pa.string()), ("name", pa.string()),
                        ("idx", pa.int32()), ("kind", pa.string()), ("size", pa.int32()), ("names", pa.list_(pa.string())), ("text", pa.string()),
                        ("num_neg", pa.bool_()), ("num_mag", pa.int64()), ("num_digits", pa.string()), ("num_exp", pa.int64()),
                    ]
                )
            ),
        ),
    ]
)
_LONG = 2**63 - 1


def _over_distinct(one: Callable[[Any], Any], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """A batch function that works each distinct value of a batch out once."""

    def run(batch: pa.Array) -> pa.Array:
        coded = batch.dictionary_encode(null_encoding="encode")
        found = pa.array([one(v) for v in coded.dictionary.to_pylist()], kind)
        return found.take(coded.indices)

    return run


def _column(one: Callable[[Any], Any], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    body = _over_distinct(one, kind)

    def batch(v: pa.Array) -> pa.Array:
        return body(v)

    return F.arrow_udf(batch, ddl)


def body_errors(schema: Schema, required: bool = False, keep_branches: bool = False) -> Callable[[Column], Column]:
    """All failures of raw bodies. A null or empty body is absent."""
    return _column(lambda v: [e._asdict() for e in check_text(schema, v, required, keep_branches)], _ERRORS, f"array<{ERROR}>")


def decoded(decoder: Any) -> Callable[[Column], Column]:
    """(value, error) of raw queries or paths, the first failure being the error; null gives null."""

    def one(raw: str | None) -> dict | None:
        if raw is None:
            return None
        try:
            return {"value": decoder.decode(raw), "error": None}
        except ValueError as e:
            return {"value": None, "error": str(e)}

    return _column(one, _DECODED, "struct<value:string,error:string>")


def _number(n: Num) -> dict:
    fits = abs(n.exp) < _LONG // 2
    return {
        "num_neg": n.sign == "-",
        "num_mag": n.mag if fits else _LONG * (1 if n.exp > 0 else -1),
        "num_digits": n.digits,
        "num_exp": n.exp if fits else _LONG * (1 if n.exp > 0 else -1),
    }


def strict(value: str | bytes | None) -> dict | None:
    """A text's canonical form, hash and node table, or what keeps it from being strict JSON."""
    if value is None:
        return None
    try:
        v = parse(value)
    except JSONError as e:
        return {"error": str(e), "canonical": None, "hash": None, "nodes": None}
    text = canonical(v)
    rows = []
    children: dict[str, list] = {}
    flat = flatten(v)
    for n in flat:
        if n.parent is not None:
            children.setdefault(n.parent, []).append(n.name)
    for i, n in enumerate(flat):
        row = {"ord": i, "template": n.template, "pointer": n.pointer, "parent": n.parent, "name": n.name, "idx": n.index, "kind": n.kind, "text": n.text}
        if n.kind in ("array", "object"):
            own = children.get(n.pointer, [])
            row |= {"size": len(own), "names": own if n.kind == "object" else None}
        rows.append(row | (_number(Num.parse(n.text)) if n.kind == "number" else {}))
    return {"error": None, "canonical": text, "hash": digest(v), "nodes": rows}


def strict_nodes(column: Column) -> Column:
    """struct(error, canonical, hash, nodes) of raw JSON."""
    ddl = f"struct<error:string,canonical:string,hash:string,nodes:array<{NODE}>>"
    return _column(strict, _NODES, ddl)(column)


def canonical_json(column: Column) -> Column:
    """Canonical text of raw JSON, null if it is not strict JSON."""
    return _column(lambda v: (strict(v) or {}).get("canonical"), pa.string(), "string")(column)


def json_hash(column: Column) -> Column:
    """SHA-256, in hex, of the canonical text of raw JSON, null if it is not strict JSON."""
    return _column(lambda v: (strict(v) or {}).get("hash"), pa.string(), "string")(column)
