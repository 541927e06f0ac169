"""OpenAPI 3.0 documents: reading, references, operations and their parameters."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from ..functions.exact import JSONError, Num, escape_token, parse

# The grammar of Semantic Versioning 2.0.0 and the members of a Path Item.
_PART = "(?:0|[1-9][0-9]*)"
_WORD = "(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = re.compile(rf"({_PART})\.({_PART})\.{_PART}(?:-{_WORD}(?:\.{_WORD})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?")
METHODS = ("delete", "get", "head", "options", "patch", "post", "put", "trace")
ITEM_FIELDS = {"$ref", "summary", "description", "servers", "parameters", *METHODS}
PARAMETER_FIELDS = {
    "name", "in", "description", "required", "deprecated", "allowEmptyValue", "style", "explode", "allowReserved",
    "schema", "example", "examples", "content",
}
OPERATION_ID = re.compile("[A-Za-z](?:[_/-]?[A-Za-z0-9])*")
_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")


class ContractError(ValueError):
    """The document is outside what this engine compiles. pointer: where."""

    def __init__(self, pointer: str, what: str):
        super().__init__(f"{pointer}: {what}")
        self.pointer = pointer


@dataclass(frozen=True)
class Located:
    """A value of the document and its pointer."""

    value: Any
    pointer: str

    def child(self, *tokens: str) -> Located:
        value, pointer = self.value, self.pointer
        for t in tokens:
            value = value[int(t)] if isinstance(value, list) else value[t]
            pointer += "/" + escape_token(t)
        return Located(value, pointer)

    def members(self, what: str) -> dict:
        if not isinstance(self.value, dict):
            raise ContractError(self.pointer, f"{what} must be an object")
        return self.value

    def text(self, name: str) -> str:
        v = self.members("parent").get(name)
        if not isinstance(v, str):
            raise ContractError(f"{self.pointer}/{name}", f"{name} must be a string")
        return v

    def flag(self, name: str) -> bool:
        """An optional boolean member."""
        v = self.members("parent").get(name, False)
        if not isinstance(v, bool):
            raise ContractError(f"{self.pointer}/{name}", f"{name} must be a boolean")
        return v


@dataclass
class Operation:
    """What a document says about one operation."""

    operation_id: str
    template: str
    method: str
    body: Located | None = None
    body_required: bool = False
    #: the media types of its request body
    content: Located | None = None
    query: list[Located] = field(default_factory=list)
    path: list[Located] = field(default_factory=list)
    all_parameters: list = field(default_factory=list)


def load(text: str | bytes) -> Any:
    """The document's value: strict JSON, or YAML whose numbers keep their text."""
    raw = text.decode() if isinstance(text, bytes) else text
    try:
        return parse(raw)
    except JSONError as e:
        if raw.lstrip()[:1] in ("{", "[") and "duplicate" in str(e):
            raise ContractError("#", str(e)) from None
    return _yaml(raw)


def _yaml(raw: str) -> Any:
    try:
        import yaml
    except ImportError:
        raise ContractError("#", "not JSON, and no YAML reader is installed") from None
    try:
        return _plain(yaml.compose(raw, yaml.CSafeLoader if hasattr(yaml, "CSafeLoader") else yaml.SafeLoader), set())
    except yaml.YAMLError as e:
        raise ContractError("#", f"invalid YAML: {e}") from None


def _plain(node: Any, above: set[int]) -> Any:
    """A YAML node as JSON; tags are those that its schema resolved."""
    if node is None:
        return None
    if id(node) in above:
        raise ContractError("#", "recursive YAML alias")
    tag, kind = node.tag.rpartition(":")[2], node.id
    above = above | {id(node)}
    if kind == "sequence":
        return [_plain(x, above) for x in node.value]
    if kind == "mapping":
        out: dict = {}
        for k, v in node.value:
            if k.tag.endswith(":merge"):
                merged = _plain(v, above)
                for m in merged if isinstance(merged, list) else [merged]:
                    out = {**m, **out}
                continue
            if k.id != "scalar":
                raise ContractError("#", "a YAML member name must be a scalar")
            if k.value in out:
                raise ContractError("#", f"duplicate YAML member {k.value!r}")
            out[k.value] = _plain(v, above)
        return out
    if tag == "null":
        return None
    if tag == "bool":
        return node.value.lower() in ("true", "yes", "on")
    if tag in ("int", "float"):
        value = node.value.replace("_", "")
        try:
            return Num.parse(re.sub(r"^\+", "", re.sub(r"^(-?)\.", r"\g<1>0.", value)).removesuffix("."))
        except JSONError:
            pass
        try:
            return Num.of(int(value, 0) if not re.fullmatch("[-+]?0[0-7]+", value) else int(value, 8))
        except ValueError:
            raise ContractError("#", f"number {node.value!r} has no JSON form") from None
    return node.value


def identifier(operation_id: str) -> str:
    """A name of letters, digits and underscores for an operationId; different ids have different names."""
    if not OPERATION_ID.fullmatch(operation_id):
        raise ContractError("#", f"{operation_id!r} is no operationId")
    name = re.sub("[_/-]", lambda m: {"_": "__", "-": "_0", "/": "_1"}[m[0]], operation_id)
    return f"_x{name}" if keyword.iskeyword(name) else name


def template_parts(template: str) -> tuple[str, list[str]]:
    """(the template with its names left out, the names in order)."""
    where = f"#/paths/{escape_token(template)}"
    if not template.startswith("/"):
        raise ContractError(where, "a path template must begin with /")
    names: list[str] = []
    shape, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", template):
        between = template[at : m.start()]
        if at and not between:
            raise ContractError(where, "adjacent expressions")
        shape += [between, "{}"]
        if not m[1]:
            raise ContractError(where, "empty expression")
        if m[1] in names:
            raise ContractError(where, f"repeated expression {m[1]!r}")
        names.append(m[1])
        at = m.end()
    shape.append(template[at:])
    if re.search(r"[{}]", "".join(shape).replace("{}", "")):
        raise ContractError(where, "unmatched brace or nested expression")
    return "".join(shape), names


class Document:
    """A resolved view of one document."""

    def __init__(self, text: str | bytes):
        root = load(text)
        if not isinstance(root, dict):
            raise ContractError("#", "the document must be an object")
        self.root = Located(root, "#")
        version = root.get("openapi")
        m = SEMVER.fullmatch(version) if isinstance(version, str) else None
        if not m:
            raise ContractError("#/openapi", "must be a semantic version")
        if (m[1], m[2]) != ("3", "0"):
            raise ContractError("#/openapi", f"feature set {m[1]}.{m[2]} is not supported, only 3.0")
        self._paths = self._admit()

    # references
    def lookup(self, ref: str, at: str) -> Located:
        if not ref.startswith("#"):
            raise ContractError(at, f"external reference {ref!r}")
        here = self.root
        if ref == "#":
            return here
        if not ref.startswith("#/"):
            raise ContractError(at, f"reference {ref!r} is no JSON Pointer")
        from urllib.parse import unquote

        for raw in unquote(ref[2:]).split("/"):
            if re.search("~(?![01])", raw):
                raise ContractError(at, f"reference {ref!r} has a bad escape")
            token = raw.replace("~1", "/").replace("~0", "~")
            v = here.value
            if isinstance(v, list):
                if not re.fullmatch("0|[1-9][0-9]*", token) or int(token) >= len(v):
                    raise ContractError(at, f"reference {ref!r} names no element")
            elif not isinstance(v, dict) or token not in v:
                raise ContractError(at, f"reference {ref!r} names nothing")
            here = here.child(token)
        return here

    def chain(self, located: Located) -> Iterator[Located]:
        """The value and those that its references lead to, the last one without a reference."""
        seen = {located.pointer}
        while True:
            yield located
            v = located.value
            if not isinstance(v, dict) or "$ref" not in v:
                return
            if not isinstance(v["$ref"], str):
                raise ContractError(f"{located.pointer}/$ref", "must be a string")
            located = self.lookup(v["$ref"], located.pointer)
            if located.pointer in seen:
                raise ContractError(located.pointer, "cyclic reference")
            seen.add(located.pointer)

    def resolve(self, located: Located) -> Located:
        *_, last = self.chain(located)
        return last

    # structure
    def _admit(self) -> Located:
        if "paths" not in self.root.value:
            raise ContractError("#/paths", "required field is missing")
        paths = self.root.child("paths")
        shapes: dict[str, str] = {}
        for path in sorted(paths.members("paths"), key=str.encode):
            if path.startswith("x-"):
                continue
            shape, _ = template_parts(path)
            if shape in shapes:
                raise ContractError(paths.child(path).pointer, f"identical to template {shapes[shape]}")
            shapes[shape] = path
            self.path_item(paths.child(path))
        return paths

    def path_item(self, item: Located) -> None:
        for name in item.members("Path Item"):
            if name not in ITEM_FIELDS and not name.startswith("x-"):
                raise ContractError(f"{item.pointer}/{escape_token(name)}", "unsupported Path Item field")

    def reference_alone(self, item: Located) -> None:
        """A Path Item's reference has no fields beside it."""
        if isinstance(item.value, dict) and "$ref" in item.value and any(n != "$ref" and not n.startswith("x-") for n in item.value):
            raise ContractError(f"{item.pointer}/$ref", "fields beside a Path Item's reference have no defined meaning")

    def operations(self) -> dict[str, Operation]:
        """By operationId, over sorted paths and methods."""
        out: dict[str, Operation] = {}
        for path in sorted(self._paths.value, key=str.encode):
            if path.startswith("x-"):
                continue
            _, names = template_parts(path)
            item = self.resolve(self._paths.child(path))
            self.path_item(item)
            shared = self._parameters(item)
            for (name, where), p in shared.items():
                if where == "path" and name not in names:
                    raise ContractError(p.pointer, f"path parameter {name!r} has no expression in {path!r}")
            for method in METHODS:
                if method in item.value:
                    op = self._operation(path, names, method, item.child(method), shared)
                    if op.operation_id in out:
                        raise ContractError(item.child(method).pointer, f"operationId {op.operation_id!r} is not unique")
                    out[op.operation_id] = op
        return out

    def _parameters(self, owner: Located) -> dict[tuple[str, str], Located]:
        out: dict[tuple[str, str], Located] = {}
        if "parameters" not in owner.value:
            return out
        listed = owner.child("parameters")
        if not isinstance(listed.value, list):
            raise ContractError(listed.pointer, "must be an array")
        for i in range(len(listed.value)):
            p = self.resolve(listed.child(str(i)))
            identity = self._parameter(p)
            if identity in out:
                raise ContractError(p.pointer, f"duplicate parameter {identity}")
            out[identity] = p
        return out

    def _parameter(self, p: Located) -> tuple[str, str]:
        m = p.members("parameter")
        name, where = m.get("name"), m.get("in")
        if not isinstance(name, str) or not name:
            raise ContractError(p.pointer, "name must be a non-empty string")
        if where not in ("query", "header", "path", "cookie"):
            raise ContractError(p.pointer, "in must be query, header, path or cookie")
        if ("schema" in m) == ("content" in m):
            raise ContractError(p.pointer, "exactly one of schema and content is needed")
        for f in m:
            if f not in PARAMETER_FIELDS and not f.startswith("x-"):
                raise ContractError(p.pointer, f"unsupported parameter field {f!r}")
        for f in ("required", "deprecated", "allowEmptyValue", "allowReserved", "explode"):
            p.flag(f)
        for f in ("description", "style"):
            if f in m:
                p.text(f)
        if where == "path" and not p.flag("required"):
            raise ContractError(p.pointer, "a path parameter must be required")
        if "example" in m and "examples" in m:
            raise ContractError(p.pointer, "example and examples exclude each other")
        if "content" in m:
            for f in ("allowReserved", "style", "explode"):
                if f in m:
                    raise ContractError(f"{p.pointer}/{f}", "cannot stand beside content")
            self.content_schema(p)
        elif not isinstance(m["schema"], dict):
            raise ContractError(f"{p.pointer}/schema", "must be an object")
        return name, where

    def content_schema(self, p: Located) -> tuple[str, Located]:
        """(media type, schema) of a parameter's content."""
        content = p.child("content")
        if len(content.members("content")) != 1:
            raise ContractError(content.pointer, "exactly one media type is needed")
        name = next(iter(content.value))
        kind = media_type(name)
        if kind is None or kind.count("/") != 1:
            raise ContractError(content.pointer, f"malformed media type {name!r}")
        return name, media_schema(content.child(name))

    def _operation(self, path: str, names: list[str], method: str, at: Located, shared: dict) -> Operation:
        m = at.members("operation")
        own = self._parameters(at)
        identity = m.get("operationId")
        if not isinstance(identity, str) or not OPERATION_ID.fullmatch(identity):
            raise ContractError(at.pointer, "operationId must be a non-empty name")
        both = {k: own.pop(k, v) for k, v in shared.items()} | own
        op = Operation(identity, path, method)
        declared = [n for n, where in both if where == "path"]
        for n in names:
            if n not in declared:
                raise ContractError(at.pointer, f"template expression {n!r} has no parameter")
        for n in declared:
            if n not in names or "/" in n:
                raise ContractError(at.pointer, f"path parameter {n!r} has no expression in {path!r}")
        op.query = [p for (_, where), p in both.items() if where == "query"]
        op.path = [both[n, "path"] for n in names]
        op.all_parameters = list(both.items())
        if "requestBody" in m:
            body = self.resolve(at.child("requestBody"))
            required = body.members("request body") and body.flag("required")
            if "content" not in body.value:
                raise ContractError(body.pointer, "content does not exist")
            content = op.content = body.child("content")
            chosen = json_media_type(content.members("content"))
            if chosen is not None:
                op.body, op.body_required = media_schema(content.child(chosen)), bool(required)
        return op


def media_type(name: str) -> str | None:
    """The type of a media type's text, without parameters; None if malformed."""
    head, *rest = _segments(name)
    head = head.strip(" \t").lower()
    if not all(_TOKEN.fullmatch(x) for x in head.split("/")) or head.count("/") > 1:
        return None
    seen = set()
    for part in rest:
        key, eq, value = part.strip(" \t").partition("=")
        if not part.strip(" \t") and part is rest[-1]:
            continue
        quoted = re.fullmatch(r'"(?:[^"\\]|\\.)*"', value)
        if not eq or not _TOKEN.fullmatch(key.strip(" \t")) or not (quoted or _TOKEN.fullmatch(value.strip(" \t"))) or key.lower() in seen:
            return None
        seen.add(key.lower())
    return head


def strict_parameters(name: str) -> bool:
    """Whether a media type's parameters have no blank beside '=' and none is empty or repeated."""
    seen = set()
    for part in _segments(name)[1:]:
        key, eq, value = part.lstrip(" \t").partition("=")
        if not eq or not key or not value or key[-1] in " \t" or value[0] in " \t" or key.lower() in seen:
            return False
        seen.add(key.lower())
    return True


def _segments(name: str) -> list[str]:
    """The text between semicolons outside quotes."""
    return re.findall(r'(?:^|;)((?:"(?:\\.|[^"\\])*"?|[^;"])*)', name)


def json_media_type(content: dict) -> str | None:
    """The most specific key that stands for application/json; an exact key goes before a parsed one."""
    for want in ("application/json", "application/*", "*/*"):
        if want in content:
            return want
        for name in sorted(content, key=str.encode):
            if media_type(name) == want:
                return name
    return None


def media_schema(at: Located) -> Located:
    """The schema of a Media Type Object; without one, any value will do."""
    m = at.members("Media Type Object")
    return Located(m.get("schema", {}), f"{at.pointer}/schema")
