"""Schemas, compiled once on the driver.

A Schema is immutable after compilation and shared by all occurrences that resolve to
the same pointer. References cannot recur, so every schema has a finite depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from ..functions.exact import Num, canonical, escape_token, kind_of
from ..functions.formats import INERT, NUMERIC, STRING
from ..functions.patterns import Pattern, PatternError, compile_pattern
from ..sources.document import ContractError, Document, Located

# The keywords that a schema may hold.
KEYWORDS = {
    "$ref", "type", "nullable", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "items", "minProperties", "maxProperties",
    "required", "properties", "additionalProperties", "allOf", "anyOf", "title", "description", "default", "example",
    "deprecated", "readOnly", "writeOnly", "xml", "externalDocs",
}
TYPES = ("boolean", "integer", "number", "string", "array", "object")
SCALARS = ("boolean", "integer", "number", "string")


@dataclass(eq=False)
class Schema:
    pointer: str
    type: str = ""
    nullable: bool = False
    enum: list[Any] = field(default_factory=list)
    #: canonical text -> place in enum
    members: dict[str, int] = field(default_factory=dict)
    minimum: Num | None = None
    exclusive_minimum: bool = False
    maximum: Num | None = None
    exclusive_maximum: bool = False
    multiple_of: Num | None = None
    number_format: str = ""
    min_length: Num | None = None
    max_length: Num | None = None
    pattern: Pattern | None = None
    string_format: str = ""
    min_items: Num | None = None
    max_items: Num | None = None
    items: Schema | None = None
    min_properties: Num | None = None
    max_properties: Num | None = None
    required: list[str] = field(default_factory=list)
    properties: dict[str, Schema] = field(default_factory=dict)
    additional: Schema | None = None
    closed: bool = False
    all_of: list[Schema] = field(default_factory=list)
    any_of: list[Schema] = field(default_factory=list)

    def children(self) -> list[Schema]:
        one = [x for x in (self.items, self.additional) if x is not None]
        return [*one, *self.properties.values(), *self.all_of, *self.any_of]


class Compiler:
    """Compiles schemas of one document; options go to its patterns."""

    def __init__(self, document: Document, **pattern_options: bool):
        self.document, self.options = document, pattern_options
        self.done: dict[str, Schema] = {}
        self.active: set[str] = set()

    def compile(self, at: Located) -> Schema:
        for step in self.document.chain(at):
            if isinstance(step.value, dict):
                for word in ("uniqueItems", "discriminator"):
                    if word in step.value:
                        raise ContractError(f"{step.pointer}/{word}", f"{word} is not supported")
            at = step
        if at.pointer in self.active:
            raise ContractError(at.pointer, "recursive schema")
        if at.pointer in self.done:
            return self.done[at.pointer]
        m = at.members("schema")
        for word in ("oneOf", "not", *m):
            if word in m and word not in KEYWORDS and not word.startswith("x-"):
                raise ContractError(f"{at.pointer}/{escape_token(word)}", "unsupported schema keyword")
        s = self.done[at.pointer] = Schema(at.pointer)
        self.active.add(at.pointer)
        try:
            self._fill(s, at, m)
        finally:
            self.active.discard(at.pointer)
        return s

    def _fill(self, s: Schema, at: Located, m: dict) -> None:
        def fail(word: str, what: str) -> ContractError:
            return ContractError(f"{at.pointer}/{word}", what)

        def number(word: str) -> Num | None:
            if word in m and not isinstance(m[word], Num):
                raise fail(word, "must be a number")
            return m.get(word)

        def count(word: str) -> Num | None:
            v = m.get(word)
            if word in m and (not isinstance(v, Num) or not v.is_integer() or v.sign):
                raise fail(word, "must be a non-negative integer")
            return v

        if "type" in m:
            s.type = at.text("type")
            if s.type not in TYPES:
                raise fail("type", f"unsupported type {s.type!r}")
        s.nullable = at.flag("nullable") and bool(s.type)
        self._format(s, m, at)
        self._documentation(s, m, at, fail)
        if "enum" in m:
            if not isinstance(m["enum"], list) or not m["enum"]:
                raise fail("enum", "must be a non-empty array")
            for v in m["enum"]:
                if (key := canonical(v)) not in s.members:
                    s.members[key] = len(s.enum)
                    s.enum.append(v)
        s.minimum, s.maximum = number("minimum"), number("maximum")
        s.exclusive_minimum = at.flag("exclusiveMinimum") and s.minimum is not None
        s.exclusive_maximum = at.flag("exclusiveMaximum") and s.maximum is not None
        s.multiple_of = number("multipleOf")
        if s.multiple_of is not None and s.multiple_of <= Num.of(0):
            raise fail("multipleOf", "must be greater than zero")
        s.min_length, s.max_length = count("minLength"), count("maxLength")
        if "pattern" in m:
            try:
                s.pattern = compile_pattern(at.text("pattern"), **self.options)
            except PatternError as e:
                raise fail("pattern", str(e)) from None
        s.min_items, s.max_items = count("minItems"), count("maxItems")
        if s.type == "array" and "items" not in m:
            raise fail("items", "must be present when type is array")
        if "items" in m:
            s.items = self.compile(at.child("items"))
        s.min_properties, s.max_properties = count("minProperties"), count("maxProperties")
        if "required" in m:
            names = m["required"]
            if not isinstance(names, list) or not names or not all(isinstance(n, str) for n in names) or len(set(names)) < len(names):
                raise fail("required", "must be a non-empty array of unique strings")
            s.required = sorted(names, key=str.encode)
        if "properties" in m:
            for name in sorted(at.child("properties").members("properties"), key=str.encode):
                child = at.child("properties", name)
                s.properties[name] = self.compile(child)
                own = self.document.resolve(child)
                if own.flag("readOnly"):
                    if own.flag("writeOnly"):
                        raise ContractError(f"{own.pointer}/writeOnly", "readOnly and writeOnly exclude each other")
                    s.required = [n for n in s.required if n != name]
        if isinstance(m.get("additionalProperties"), bool):
            s.closed = not m["additionalProperties"]
        elif "additionalProperties" in m:
            s.additional = self.compile(at.child("additionalProperties"))
        for word, into in (("allOf", s.all_of), ("anyOf", s.any_of)):
            if word in m:
                if not isinstance(m[word], list) or not m[word]:
                    raise fail(word, "must be a non-empty array")
                into += [self.compile(at.child(word, str(i))) for i in range(len(m[word]))]

    def _format(self, s: Schema, m: dict, at: Located) -> None:
        if "format" not in m:
            return
        name = at.text("format")
        if name in NUMERIC:
            allowed = ("", "integer", "number") if name.startswith("int") else ("", "number")
            s.number_format = name
        elif name in STRING or name in INERT:
            allowed = ("", "string")
            s.string_format = name
        else:
            raise ContractError(f"{at.pointer}/format", f"unsupported format {name!r}")
        if s.type not in allowed:
            raise ContractError(f"{at.pointer}/format", f"format {name!r} does not go with type {s.type!r}")

    def _documentation(self, s: Schema, m: dict, at: Located, fail) -> None:
        for word in ("title", "description"):
            if word in m:
                at.text(word)
        for word in ("readOnly", "writeOnly", "deprecated"):
            at.flag(word)
        if "default" in m and s.type and not (m["default"] is None and s.nullable) and not is_type(m["default"], s.type):
            raise fail("default", f"must conform to type {s.type!r}")
        for word, texts, flags in (("xml", ("name", "prefix", "namespace"), ("attribute", "wrapped")), ("externalDocs", ("description", "url"), ())):
            if word not in m:
                continue
            own = at.child(word)
            for name in own.members(word):
                if name in texts:
                    own.text(name)
                elif name in flags:
                    own.flag(name)
                elif not name.startswith("x-"):
                    raise fail(word, f"unsupported field {name!r}")
            if word == "externalDocs" and not own.value.get("url"):
                raise fail(word, "url must not be empty")
            if word == "xml" and "namespace" in own.value and not urlsplit(own.value["namespace"]).scheme:
                raise fail(word, "namespace must be an absolute URI")


def is_type(value: Any, name: str) -> bool:
    kind = kind_of(value)
    if name == "integer":
        return kind == "number" and value.is_integer()
    return kind == name


def check_compiled(roots: list[Schema]) -> None:
    """Refuses graphs that no compilation gives, such as edited saved contracts: each shared schema is looked at once."""
    done: set[int] = set()
    active: set[int] = set()

    def fail(s: Schema, what: str) -> ContractError:
        return ContractError(s.pointer or "#", f"inconsistent compiled schema: {what}")

    def see(s: Schema) -> None:
        if id(s) in active:
            raise fail(s, "it contains itself")
        if id(s) in done:
            return
        active.add(id(s))
        if s.type and s.type not in TYPES or s.nullable and not s.type:
            raise fail(s, "type")
        if list(s.members) != [canonical(v) for v in s.enum]:
            raise fail(s, "enum")
        if s.exclusive_minimum and s.minimum is None or s.exclusive_maximum and s.maximum is None:
            raise fail(s, "an exclusive bound without a bound")
        if s.multiple_of is not None and s.multiple_of <= Num.of(0):
            raise fail(s, "multipleOf")
        for n in (s.min_length, s.max_length, s.min_items, s.max_items, s.min_properties, s.max_properties):
            if n is not None and (not n.is_integer() or n.sign):
                raise fail(s, "a count")
        if s.number_format not in ("", *NUMERIC) or s.string_format not in ("", *STRING, *INERT):
            raise fail(s, "format")
        if s.required != sorted(set(s.required), key=str.encode) or list(s.properties) != sorted(s.properties, key=str.encode):
            raise fail(s, "names out of order")
        if s.closed and s.additional is not None:
            raise fail(s, "closed and open")
        for c in s.children():
            see(c)
        active.discard(id(s))
        done.add(id(s))

    for s in roots:
        see(s)
