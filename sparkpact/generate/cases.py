"""Test rows that cover a schema: a valid row for each obligation, a row with one fault for each rule.

An obligation is a level to reach (a kind, an enum member, a rule that applies and holds,
a truth mask of alternatives) or a fault to isolate, at one occurrence of a schema in
an instance. build() works through them on the driver with one budget of steps; a step is
the evaluation of one candidate. generate_cases() gives each obligation a budget
of its own and searches them on the executors, so its rows may differ from build()'s.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.exact import canonical, escape_token, kind_of
from ..operators.evaluate import Run, Violation
from ..plans.schema import Compiler, Schema
from ..plans.wire import conjuncts
from ..sources.admission import admit
from ..sources.document import ContractError, Document, json_media_type, media_type
from .witnesses import CANONICAL, EXTRA, KINDS, beyond_limits, candidates, kinds_of, wrong_values

#: The order of rules; a format's place depends on whether it is one of numbers or of strings.
RULES = (
    "type", "enum", "minimum", "maximum", "multipleOf", "number format", "minLength", "maxLength", "pattern", "format",
    "minItems", "maxItems", "minProperties", "maxProperties", "required", "additionalProperties", "allOf", "anyOf",
)
ANY = "+"  # in templates: an undeclared member
#: No value: None is the JSON null.
NOTHING = object()


class Obligation(NamedTuple):
    pointer: str
    template: str
    rule: str
    target: str

    def __str__(self) -> str:
        return "|".join(self)


class Case(NamedTuple):
    json: str
    valid: bool


@dataclass
class Report:
    stop_reason: str
    steps: int
    covered: list[Obligation] = field(default_factory=list)
    uncovered: list[Obligation] = field(default_factory=list)


def occurrences(s: Schema, template: str = "#", beside: tuple[Schema, ...] = ()) -> Iterator[tuple[Schema, str, tuple[Schema, ...]]]:
    """A schema and all below it, each with its instance template and the conjuncts that a value there has to meet.

    In templates '*' is an index, '+' an undeclared member. Siblings are the conjuncts above.
    """
    joint = (*beside, *conjuncts(s))
    yield s, template, joint
    if s.items is not None:
        yield from occurrences(s.items, f"{template}/*")
    for name, c in s.properties.items():
        yield from occurrences(c, f"{template}/{escape_token(name)}")
    if s.additional is not None:
        yield from occurrences(s.additional, f"{template}/{ANY}")
    for c in (*s.all_of, *s.any_of):
        yield from occurrences(c, template, joint)


def _rules(s: Schema) -> Iterator[tuple[str, bool]]:
    """(rule, whether it can fail) for the plain rules of a schema."""
    plain = (
        ("minimum", s.minimum), ("maximum", s.maximum), ("multipleOf", s.multiple_of), ("minLength", s.min_length),
        ("maxLength", s.max_length), ("pattern", s.pattern), ("minItems", s.min_items), ("maxItems", s.max_items),
        ("minProperties", s.min_properties), ("maxProperties", s.max_properties),
    )
    for word, bound in plain:
        if bound is not None:
            # a count is never below zero
            yield word, not (word in ("minLength", "minItems", "minProperties") and bound.digits == "0")
    if s.number_format or s.string_format:
        yield "format", s.string_format != "password"


def obligations(root: Schema) -> list[Obligation]:
    """All of them, without repeats, in a fixed order."""
    out: dict[Obligation, None] = {}
    rank: dict[Obligation, int] = {}
    for s, at, joint in occurrences(root):

        def add(rule: str, target: str, s=s, at=at) -> None:
            o = Obligation(s.pointer, at, rule, target)
            out.setdefault(o)
            rank[o] = RULES.index("number format" if rule == "format" and s.number_format else rule)

        for kind in kinds_of(list(joint)):
            add("type", f"level:{kind}")
        if s.type:
            add("type", "fault:type")
        for i in range(len(s.enum)):
            add("enum", f"level:member:{i}")
        if s.enum:
            add("enum", "fault:enum")
        for word, fails in _rules(s):
            add(word, "level:valid")
            if fails:
                add(word, f"fault:{word}")
        for name in s.required:
            add("required", f"level:{name}")
            add("required", f"fault:{name}")
        if s.closed:
            add("additionalProperties", "level:valid")
            add("additionalProperties", "fault:additionalProperties")
        if s.all_of:
            add("allOf", "level:all-true")
        if s.any_of:
            for mask in masks(s):
                add("anyOf", f"level:mask:{mask}")
            add("anyOf", "fault:anyOf")
    return sorted(out, key=lambda o: (_tokens(o.pointer), _tokens(o.template), rank[o], o.target.startswith("fault"), _target(o.target)))


def _tokens(pointer: str) -> list[tuple]:
    """A pointer's tokens in order: indices by number, names by bytes."""
    return [(0, int(t), b"") if t.isdecimal() and t.isascii() else (1, 0, t.replace("~1", "/").replace("~0", "~").encode()) for t in pointer.split("/")[1:]]


def _target(target: str) -> tuple:
    *_, last = target.split(":")
    if target.startswith("level:") and last in KINDS:
        return (0, KINDS.index(last), "")
    return (1, int(last), "") if last.isdecimal() and last.isascii() else (2, 0, target)


def masks(s: Schema) -> list[int]:
    """Truth masks of the alternatives that witnesses reach; bit i is alternative i."""
    pool = [v for k in KINDS for v in CANONICAL[k]]
    pool += candidates(s)
    found = set()
    for v in pool:
        truth = [not Run().check(b, v) for b in s.any_of]
        if any(truth) and not Run().check(s, v):
            found.add(sum(1 << i for i, t in enumerate(truth) if t))
    return sorted(found)


def observed(root: Schema, value: Any) -> set[Obligation]:
    """The levels that a valid value reaches."""
    out: set[Obligation] = set()

    def see(s: Schema, v: Any, at: str) -> None:
        add = lambda rule, level: out.add(Obligation(s.pointer, at, rule, f"level:{level}"))
        kind = kind_of(v)
        add("type", kind)
        if s.enum and (key := canonical(v)) in s.members:
            add("enum", f"member:{s.members[key]}")
        native = {
            "number": ("minimum", "maximum", "multipleOf", "format"),
            "string": ("minLength", "maxLength", "pattern", "format"),
            "array": ("minItems", "maxItems"),
            "object": ("minProperties", "maxProperties"),
        }.get(kind, ())
        for word, _ in _rules(s):
            if word in native and (word != "format" or bool(s.string_format) == (kind == "string")):
                add(word, "valid")
        if kind == "array" and s.items is not None:
            for x in v:
                see(s.items, x, f"{at}/*")
        if kind == "object":
            for name in s.required:
                if name in v:
                    add("required", name)
            if s.closed:
                add("additionalProperties", "valid")
            for name, x in v.items():
                if name in s.properties:
                    see(s.properties[name], x, f"{at}/{escape_token(name)}")
                elif s.additional is not None:
                    see(s.additional, x, f"{at}/{ANY}")
        if s.all_of:
            add("allOf", "all-true")
        for c in s.all_of:
            see(c, v, at)
        if s.any_of:
            truth = [not Run().check(c, v) for c in s.any_of]
            add("anyOf", f"mask:{sum(1 << i for i, t in enumerate(truth) if t)}")
            for c, t in zip(s.any_of, truth, strict=True):
                if t:
                    see(c, v, at)

    see(root, value, "#")
    return out


def places(value: Any, template: str, declared: set[str]) -> Iterator[tuple]:
    """The paths in a value that a template stands for."""
    tokens = [t.replace("~1", "/").replace("~0", "~") for t in template.split("/")[1:]]

    def walk(v: Any, rest: list[str], path: tuple) -> Iterator[tuple]:
        if not rest:
            yield path
        elif rest[0] == "*" and isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, rest[1:], (*path, i))
        elif rest[0] == ANY and isinstance(v, dict):
            for n, x in v.items():
                if n not in declared:
                    yield from walk(x, rest[1:], (*path, n))
        elif isinstance(v, dict) and rest[0] in v:
            yield from walk(v[rest[0]], rest[1:], (*path, rest[0]))

    yield from walk(value, tokens, ())


def at_path(value: Any, path: tuple) -> Any:
    for p in path:
        value = value[p]
    return value


def replaced(value: Any, path: tuple, new: Any) -> Any:
    if not path:
        return new
    if isinstance(value, list):
        return [replaced(x, path[1:], new) if i == path[0] else x for i, x in enumerate(value)]
    return {k: replaced(x, path[1:], new) if k == path[0] else x for k, x in value.items()}


class Budget(Exception):
    """No steps are left."""


class Search:
    """Rows for the obligations of one schema, within a number of steps."""

    def __init__(self, root: Schema, max_steps: int):
        self.root, self.left, self.steps = root, max_steps, 0
        #: steps that one obligation may spend on new values of the root, and on edits; it grows from turn to turn
        self.share = max(64, max_steps // max(1, 2 * len(obligations(root))))
        self.valid: list[Any] = []
        self.by_key = {(s.pointer, at): s for s, at, _ in occurrences(root)}
        self.joint = {(s.pointer, at): list(joint) for s, at, joint in occurrences(root)}
        self.declared = {n for s, _, _ in occurrences(root) for n in s.properties}
        self.stream = candidates(root)
        #: whether the share ended the last search, and not its candidates
        self.cut = False

    def check(self, value: Any) -> list[Violation]:
        if not self.left:
            raise Budget
        self.left -= 1
        self.steps += 1
        return Run().check(self.root, value)

    def more_valid(self) -> Iterator[Any]:
        """Valid values: those found before, then new ones, varied at every occurrence."""
        yield from list(self.valid)
        last = self.steps + self.share
        for v in self.stream:
            if self.steps >= last:
                self.stream = itertools.chain([v], self.stream)
                self.cut = True
                return
            if not self.check(v):
                self.valid.append(v)
                yield v

    def level(self, o: Obligation) -> Any:
        """A valid value that reaches a level; first from the stream, then by edits of valid values."""
        self.cut = False
        for v in self.more_valid():
            if o in observed(self.root, v):
                return v
        s = self.by_key[o.pointer, o.template]
        last = self.steps + self.share
        for v in list(self.valid):
            for grown in self.grown(v, o.template):
                for path in places(grown, o.template, self.declared):
                    for new in self.pool(s, o):
                        if self.steps >= last:
                            self.cut = True
                            return NOTHING
                        w = replaced(grown, path, new)
                        if not self.check(w) and o in observed(self.root, w):
                            self.valid.append(w)
                            return w
        return NOTHING

    def pool(self, s: Schema, o: Obligation) -> Iterator[Any]:
        """Values that may reach a level where they stand."""
        if o.target.startswith("level:member:"):
            yield s.enum[int(o.target.rpartition(":")[2])]
        yield from candidates(Schema(s.pointer, all_of=self.joint[o.pointer, o.template]))
        yield from candidates(s)
        for k in KINDS:
            yield from CANONICAL[k]

    def grown(self, v: Any, template: str) -> Iterator[Any]:
        """v, and v with members added so that the template has a place in it."""
        yield v
        parent, _, token = template.rpartition("/")
        if not parent:
            return
        for path in places(v, parent, self.declared):
            own = at_path(v, path)
            if isinstance(own, dict):
                name = EXTRA if token == ANY else token.replace("~1", "/").replace("~0", "~")
                if name not in own:
                    yield replaced(v, path, own | {name: None})
            elif isinstance(own, list) and token == "*":
                yield replaced(v, path, [*own, None])

    def fault(self, o: Obligation) -> Any:
        """A value whose only failure is the obligation's."""
        s = self.by_key[o.pointer, o.template]
        words = {o.rule}
        if o.rule in ("minimum", "maximum"):
            words.add("exclusive" + o.rule.capitalize())
        last = self.steps + 4 * self.share
        self.cut = False
        joint = self.joint[o.pointer, o.template]
        for v in self.more_valid():
            for grown in self.grown(v, o.template):
                for path in places(grown, o.template, self.declared):
                    tried: set[str] = set()
                    for new in wrong_values(s, o.rule, at_path(grown, path), joint):
                        if (key := canonical(new)) in tried:
                            continue
                        tried.add(key)
                        if self.steps >= last:
                            self.cut = True
                            return NOTHING
                        w = replaced(grown, path, new)
                        found = self.check(w)
                        # conjuncts that state one rule alike break together; nothing else may break
                        alike = len({(x.instance_pointer, x.keyword) for x in found}) == 1
                        if alike and any(x.schema_pointer == o.pointer and x.keyword in words and self.same(o, x, path) for x in found):
                            return w
        return NOTHING

    @staticmethod
    def same(o: Obligation, found: Violation, path: tuple) -> bool:
        at = "#" + "".join(f"/{escape_token(str(p))}" for p in path)
        if o.rule == "required":
            return found.instance_pointer == f"{at}/{escape_token(o.target.removeprefix('fault:'))}"
        if o.rule == "additionalProperties":
            return found.instance_pointer.rpartition("/")[0] == at
        return found.instance_pointer == at


def build(root: Schema, max_steps: int, emit: Callable[[Case], None]) -> Report:
    """Emits valid rows, then rows with one fault; an error of emit() ends the build.

    Obligations are searched in turns, each with a larger share of the steps than the last, until all
    steps are used ('max_steps_reached') or no candidate is left for any that is open. Then the space of candidates
    is exhausted ('space_exhausted'), or it leaves out strings, arrays or objects too large to
    be built ('limits_reached').
    """
    todo = obligations(root)
    search = Search(root, max_steps)
    covered: set[Obligation] = set()
    emitted: set[str] = set()
    faults: dict[Obligation, Any] = {}  # these come last

    def put(v: Any, valid: bool) -> None:
        if (text := canonical(v)) not in emitted:
            emitted.add(text)
            emit(Case(text, valid))

    stop = "space_exhausted"
    try:
        if not max_steps:
            raise Budget
        open_ = sorted(todo, key=lambda o: o.target.startswith("fault"))
        while open_:
            again = []
            for o in open_:
                if o in covered:
                    continue
                valid = o.target.startswith("level")
                v = search.level(o) if valid else search.fault(o)
                if v is not NOTHING and valid:
                    covered |= observed(root, v) & set(todo)
                    put(v, True)
                elif v is not NOTHING:
                    covered.add(o)
                    faults[o] = v
                elif search.cut:
                    again.append(o)
            open_, search.share = again, search.share * 4
    except Budget:
        stop = "max_steps_reached"
    for o in todo:
        if o in faults:
            put(faults[o], False)
    uncovered = [o for o in todo if o not in covered]
    if stop == "space_exhausted" and any(beyond_limits(search.joint[o.pointer, o.template]) for o in uncovered):
        stop = "limits_reached"
    return Report(stop, search.steps, [o for o in todo if o in covered], uncovered)


def body_schema(text: str | bytes, operation_id: str) -> Schema:
    """The schema that an operation's JSON body has in a document, as rows are generated for it.

    Other than for validation, the media type must state a schema, and no two may be equally specific.
    """
    document = Document(text)
    admit(document)
    found = document.operations().get(operation_id)
    if found is None or found.content is None:
        raise ContractError("#/paths", f"operation {operation_id!r} has no request body")
    listed = found.content.members("content")
    chosen = json_media_type(listed)
    if chosen is None:
        raise ContractError(found.content.pointer, "no media type stands for JSON")
    alike = [n for n in listed if media_type(n) == media_type(chosen)]
    if len(alike) > 1:
        raise ContractError(found.content.pointer, f"media types {alike} are equally specific")
    media = document.resolve(found.content.child(chosen))
    if "schema" not in media.members("Media Type Object"):
        raise ContractError(media.pointer, "a schema is needed")
    return Compiler(document).compile(media.child("schema"))


def obligation_table(spark: SparkSession, root: Schema) -> DataFrame:
    rows = [(i, *o) for i, o in enumerate(obligations(root))]
    return spark.createDataFrame(rows, "ord int, pointer string, template string, rule string, target string")


def covering(root: Schema, o: Obligation, max_steps: int) -> str | None:
    """A row for one obligation, from a search of its own."""
    search = Search(root, max_steps)
    try:
        while True:
            v = search.level(o) if o.target.startswith("level") else search.fault(o)
            if v is not NOTHING or not search.cut:
                break
            search.share *= 4
    except Budget:
        return None
    return None if v is NOTHING else canonical(v)


def generate_cases(spark: SparkSession, root: Schema, max_steps: int = 2000) -> DataFrame:
    """ord, json, valid: a row for each obligation that its own search of max_steps can cover."""
    ship(spark)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text = covering(root, Obligation(row.pointer, row.template, row.rule, row.target), max_steps)
                if text is not None:
                    out.append((row.ord, text, row.target.startswith("level")))
            yield pd.DataFrame(out, columns=["ord", "json", "valid"]).astype({"ord": "int32", "valid": bool})

    # each obligation is a task's worth of work: they are dealt in turn, not by hash
    table = obligation_table(spark, root)
    return table.repartitionByRange(max(1, min(table.count(), 4 * spark.sparkContext.defaultParallelism)), "ord").mapInPandas(search, "ord int, json string, valid boolean")


def coverage(spark: SparkSession, root: Schema, cases: DataFrame) -> DataFrame:
    """The obligations, and whether a case covers each."""
    got = cases.select("ord").distinct().withColumn("covered", F.lit(True))
    return obligation_table(spark, root).join(got, "ord", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
