"""The public surface: compile a document once, then validate and decode columns with it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from .functions.exact import Num, canonical, parse
from .functions.patterns import compile_pattern
from .operators import columns, typed
from .operators.evaluate import Violation, check_text
from .plans.schema import Compiler, Schema, check_compiled
from .plans.wire import PathDecoder, QueryDecoder, Wire, decoders
from .sources.admission import admit
from .sources.document import Document, identifier


@dataclass
class Request:
    """What one operation accepts; parts that it lacks are None."""

    operation_id: str
    body: Schema | None = None
    body_required: bool = False
    query: QueryDecoder | None = None
    path: PathDecoder | None = None

    def errors(self, text: str | bytes | None) -> list[Violation]:
        """All failures of one raw body."""
        return check_text(self.body, text, self.body_required)

    def body_errors(self, body: Column) -> Column:
        """errors() of a column of bodies, as an array of structs."""
        return columns.body_errors(self.body, self.body_required)(body)

    def validate(self, df: DataFrame, body: str) -> DataFrame:
        """df with `errors`; a row is valid if it has none."""
        return df.withColumn("errors", self.body_errors(df[body]))

    def validate_table(self, df: DataFrame, keys: list[str], **options: Any) -> DataFrame:
        """Failures of rows that are objects already: keys, pointer, keyword. See operators.typed."""
        return typed.table_violations(df, self.body, keys, **options)

    def decode_query(self, raw: Column) -> Column:
        """A struct (value, error) of a column of raw queries."""
        return columns.decoded(self.query)(raw)

    def decode_path(self, raw: Column) -> Column:
        """A struct (value, error) of a column of escaped paths."""
        return columns.decoded(self.path)(raw)


class Contract:
    """A compiled document: operationId -> Request."""

    def __init__(self, requests: dict[str, Request]):
        self.requests = requests

    def __getitem__(self, operation_id: str) -> Request:
        return self.requests[operation_id]

    def __iter__(self) -> Iterator[str]:
        return iter(self.requests)

    def identifiers(self) -> dict[str, str]:
        """A distinct name of letters, digits and underscores for each operation, for views, say, or files."""
        return {identifier(name): name for name in self.requests}

    # saved contracts
    def to_json(self) -> str:
        """Every shared schema once, and what refers to it by number."""
        nodes: list[dict] = []
        seen: dict[int, int] = {}

        def put(s: Schema) -> int:
            if id(s) in seen:
                return seen[id(s)]
            out: dict[str, Any] = {}
            for name, v in vars(s).items():
                if name == "members" or v in (None, "", False) or v == [] or v == {}:
                    continue
                if name in ("items", "additional"):
                    out[name] = put(v)
                elif name in ("all_of", "any_of"):
                    out[name] = [put(x) for x in v]
                elif name == "properties":
                    out[name] = {n: put(x) for n, x in v.items()}
                elif name == "enum":
                    out[name] = [canonical(x) for x in v]
                elif name == "pattern":
                    out[name] = [v.source, v.ascii_only, v.native]
                else:
                    out[name] = {"number": v.lexeme} if isinstance(v, Num) else v
            seen[id(s)] = len(nodes)
            nodes.append(out)
            return seen[id(s)]

        def wire(w: Wire) -> dict:
            out = {k: v for k, v in vars(w).items() if k not in ("schema", "branches", "default")}
            return out | {"schema": put(w.schema), "branches": [wire(b) for b in w.branches], "default": canonical(w.default)}

        requests = {}
        for name, r in self.requests.items():
            requests[name] = {
                "body": None if r.body is None else put(r.body),
                "body_required": r.body_required,
                "query": None if r.query is None else [wire(w) for w in r.query.wires],
                "path": None if r.path is None else [r.path.template, [wire(w) for w in r.path.wires]],
            }
        return json.dumps({"schemas": nodes, "requests": requests}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        data = json.loads(text)
        nodes: list[Schema] = []
        for raw in data["schemas"]:
            s = Schema(raw["pointer"])
            for name, v in raw.items():
                if name in ("items", "additional"):
                    v = nodes[v]
                elif name in ("all_of", "any_of"):
                    v = [nodes[i] for i in v]
                elif name == "properties":
                    v = {n: nodes[i] for n, i in v.items()}
                elif name == "enum":
                    s.members = {c: i for i, c in enumerate(v)}
                    v = [parse(c) for c in v]
                elif name == "pattern":
                    v = compile_pattern(v[0], reject_non_ascii=v[1], use_native=v[2])
                elif isinstance(v, dict):
                    v = Num.parse(v["number"])
                setattr(s, name, v)
            nodes.append(s)
        check_compiled(nodes)

        def wire(raw: dict) -> Wire:
            own = dict(raw, schema=nodes[raw["schema"]], branches=[wire(b) for b in raw["branches"]], default=parse(raw["default"]))
            own["properties"] = {n: tuple(v) for n, v in raw["properties"].items()}
            return Wire(**own)

        out = {}
        for name, r in data["requests"].items():
            out[name] = Request(
                name,
                None if r["body"] is None else nodes[r["body"]],
                r["body_required"],
                None if r["query"] is None else QueryDecoder(name, [wire(w) for w in r["query"]]),
                None if r["path"] is None else PathDecoder(name, r["path"][0], [wire(w) for w in r["path"][1]]),
            )
        return cls(out)

    def save(self, spark: SparkSession, path: str) -> None:
        """The contract as a table of one text column; any folder that Spark can write."""
        spark.createDataFrame([(self.to_json(),)], "contract string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Contract:
        return cls.from_json(spark.read.parquet(path).first()["contract"])


def compile_contract(text: str | bytes, reject_non_ascii: bool = False, use_native: bool = False) -> Contract:
    """Compiles an OpenAPI 3.0 document, JSON or YAML; all of it or, by ContractError, nothing.

    reject_non_ascii: patterns must be ASCII, and other subjects fail them. use_native: patterns
    are the JVM's own and match code points.
    """
    document = Document(text)
    admit(document)
    out = {}
    for name, op in sorted(document.operations().items()):
        compiler = Compiler(document, reject_non_ascii=reject_non_ascii, use_native=use_native)
        request = Request(name, body_required=op.body_required)
        if op.body is not None:
            request.body = compiler.compile(op.body)
        request.query, request.path = decoders(document, op, compiler)
        check_compiled(list(compiler.done.values()))
        out[name] = request
    return Contract(out)
