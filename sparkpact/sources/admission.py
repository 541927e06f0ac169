"""What a whole document must not hold, whether any operation reaches it or not.

SLOTS says, for each kind of object, which members lead to which kinds. The walk visits all of
them from the paths and components on: references must lead to objects of the document
without turning back, Path Items must be well formed, and no schema may hold what this engine excludes.
An object that several references lead to is looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from .document import METHODS, ContractError, Document, Located

ONE, LIST, MAP = "one", "list", "map"
_CONTENT = ("content", MAP, "media type")
_EXAMPLES = ("examples", MAP, "example")
_SCHEMA = ("schema", ONE, "schema")
#: kind -> (member, how it holds them, their kind); in the order of the walk. A member "*" stands for all of an object's.
SLOTS: dict[str, list[tuple[str, str, str]]] = {
    "document": [("paths", ONE, "paths"), ("components", ONE, "components")],
    "paths": [("*", MAP, "path item")],
    "components": [
        ("schemas", MAP, "schema"), ("parameters", MAP, "parameter"), ("requestBodies", MAP, "request body"), ("responses", MAP, "response"),
        ("headers", MAP, "header"), ("callbacks", MAP, "callback"), _EXAMPLES, ("securitySchemes", MAP, "security scheme"), ("links", MAP, "link"),
    ],
    "path item": [("parameters", LIST, "parameter"), *((m, ONE, "operation") for m in METHODS)],
    "operation": [("parameters", LIST, "parameter"), ("requestBody", ONE, "request body"), ("responses", MAP, "response"), ("callbacks", MAP, "callback")],
    "parameter": [_EXAMPLES, _SCHEMA, _CONTENT],
    "header": [_EXAMPLES, _SCHEMA, _CONTENT],
    "request body": [_CONTENT],
    "response": [("headers", MAP, "header"), _CONTENT, ("links", MAP, "link")],
    "callback": [("*", MAP, "path item")],
    "media type": [_SCHEMA, _EXAMPLES, ("encoding", MAP, "encoding")],
    "encoding": [("headers", MAP, "header")],
    "schema": [
        ("items", ONE, "schema"), ("properties", MAP, "schema"), ("additionalProperties", ONE, "schema"),
        ("allOf", LIST, "schema"), ("anyOf", LIST, "schema"), ("oneOf", LIST, "schema"), ("not", ONE, "schema"),
    ],
}
#: Kinds that may be given by reference, and must be objects.
_REFERABLE = ("path item", "parameter", "header", "request body", "response", "callback", "example", "security scheme", "link", "schema")
#: Maps whose extension members are no entries.
_EXTENSIBLE = ("paths", "callback", "responses")


def _entries(at: Located, member: str, how: str, kind: str) -> Iterator[Located]:
    owner = at if member == "*" else at.child(member)
    value = owner.value
    if how == ONE:
        # additionalProperties may be a flag
        if not (member == "additionalProperties" and isinstance(value, bool)):
            yield owner
    elif how == LIST:
        yield from (owner.child(str(i)) for i in range(len(value) if isinstance(value, list) else 0))
    elif isinstance(value, dict):
        skip = member in _EXTENSIBLE or member == "*"
        yield from (owner.child(n) for n in sorted(value, key=str.encode) if not (skip and n.startswith("x-")))
    elif kind == "callback":
        raise ContractError(owner.pointer, "must be an object")


def _check(document: Document, kind: str, at: Located) -> None:
    m = at.value
    if kind == "path item":
        document.path_item(at)
        for name in METHODS:
            if name in m and not isinstance(m[name], dict):
                raise ContractError(f"{at.pointer}/{name}", "must be an object")
    if kind in ("path item", "operation") and not isinstance(m.get("parameters", []), list):
        raise ContractError(f"{at.pointer}/parameters", "must be an array")
    if kind == "schema":
        for word in ("uniqueItems", "discriminator"):
            if word in m:
                word = "oneOf" if word == "discriminator" and "oneOf" in m else word
                raise ContractError(f"{at.pointer}/{word}", f"{word} is not supported")


def admit(document: Document) -> None:
    """Refuses, by ContractError, what is broken or excluded anywhere in the document."""
    done: set[tuple[str, str]] = set()
    active: set[tuple[str, str]] = set()
    #: (kind, where, whether all below it has been seen)
    todo: list[tuple[str, Located, bool]] = [("document", document.root, False)]
    while todo:
        kind, at, left = todo.pop()
        if left:
            active.discard((kind, at.pointer))
            done.add((kind, at.pointer))
            continue
        if kind == "path item":
            document.reference_alone(at)
        here = document.resolve(at) if kind in _REFERABLE else at
        if not isinstance(here.value, dict):
            if kind in _REFERABLE:
                raise ContractError(here.pointer, f"a {kind} must be an object")
            continue
        key = (kind, here.pointer)
        if key in active:
            raise ContractError(at.pointer, f"recursive {kind} reaching {here.pointer}")
        if key in done:
            continue
        active.add(key)
        _check(document, kind, here)
        todo.append((kind, here, True))
        below = [(k, e, False) for member, how, k in SLOTS.get(kind, []) if member == "*" or member in here.value for e in _entries(here, member, how, k)]
        todo += reversed(below)
