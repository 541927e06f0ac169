"""ECMAScript 5.1 patterns, as regular expressions for the JVM and for Python.

A pattern is parsed on the driver into nested tuples, checked against the limits, and
rendered with explicit character sets, so that neither engine's own idea of \\d, \\s, \\b,
dot or $ plays a part. Matching counts UTF-16 units: a subject with characters
beyond U+FFFF is rewritten first, each surrogate as one character (0x10000 and up).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, and the white space of ECMAScript 5.1.
MAX_SOURCE, MAX_DEPTH, MAX_NODES, MAX_TEXT = 65536, 100, 10000, 1 << 20
MAX_REPEAT, MAX_ASSERTIONS = 1000, 64
DIGIT = ((0x30, 0x39),)
WORD = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
SPACE = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200B),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
LINE_ENDS = ((0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029))
TOP = 0xFFFF

Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """kind: 'syntax', 'unsupported', 'foreign', 'policy' or 'complexity'; offset: in bytes of UTF-8."""

    def __init__(self, kind: str, offset: int, what: str):
        super().__init__(f"pattern at byte {offset}: {kind}: {what}")
        self.kind, self.offset = kind, offset


def merged(ranges) -> Ranges:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def complement(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in merged(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= TOP:
        out.append((at, TOP))
    return tuple(out)


SETS = {"d": DIGIT, "D": complement(DIGIT), "s": SPACE, "S": complement(SPACE), "w": WORD, "W": complement(WORD)}
CONTROLS = {"f": 0x0C, "n": 0x0A, "r": 0x0D, "t": 0x09, "v": 0x0B}


def units(c: str) -> tuple[int, ...]:
    u = ord(c)
    return (u,) if u <= TOP else (0xD800 + ((u - 0x10000) >> 10), 0xDC00 + (u & 0x3FF))


# Nodes: ("any", [seq]), ("seq", [node]), ("lit", units), ("set", ranges), ("begin",), ("end",), ("edge",), ("noedge",),
# ("group", any), ("look", positive, any), ("rep", node, low, high or None, lazy, counted)
class _Parser:
    def __init__(self, source: str):
        self.s, self.i = source, 0
        self.nodes = self.captures = self.depth = 0
        self.references: list[tuple[int, int]] = []
        self.looks = 0
        self.first_look: int | None = None

    def error(self, kind: str, what: str, at: int | None = None) -> PatternError:
        return PatternError(kind, len(self.s[: self.i if at is None else at].encode()), what)

    def node(self, *parts):
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise self.error("complexity", "too many nodes")
        return parts

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.s):
            raise self.error("syntax", "unmatched closing parenthesis")
        for at, value in self.references[:1]:
            if value <= self.captures:
                raise self.error("unsupported", "backreference", at)
            raise self.error("syntax", "decimal escape beyond the pattern's groups", at)
        self.place_looks(tree)
        return tree

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            found.append(self.sequence())
        return self.node("any", found)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            start = self.i
            item = self.atom()
            if self.peek() and self.peek() in "*+?{":
                if item[0] in ("begin", "end", "edge", "noedge", "look"):
                    raise self.error("syntax", "an assertion cannot be repeated", start)
                item = self.repeat(item)
            items.append(item)
        return self.node("seq", items)

    def atom(self):
        c = self.peek()
        if c == "(":
            return self.group()
        if c == "[":
            return self.set_()
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            raise self.error("syntax", "nothing to repeat")
        if c in "}]":
            raise self.error("syntax", f"unescaped {c}")
        self.i += 1
        if c == "^":
            return self.node("begin")
        if c == "$":
            return self.node("end")
        if c == ".":
            return self.node("set", complement(LINE_ENDS))
        return self.node("lit", units(c))

    def group(self):
        start = self.i
        self.i += 1
        make = ("group",)
        if self.peek() == "*":
            raise self.error("foreign", "control verb", start)
        if self.peek() == "?":
            mark = self.peek(2)
            if len(mark) < 2:
                raise self.error("syntax", "incomplete group", start)
            if mark[1] not in ":=!":
                raise self.error("foreign", f"group (?{mark[1]}", start)
            if mark[1] != ":":
                make = ("look", mark[1] == "=")
                self.looks += 1
                self.first_look = start if self.first_look is None else self.first_look
            self.i += 2
        else:
            self.captures += 1
        if self.depth == MAX_DEPTH:
            raise self.error("complexity", "nesting depth", start)
        self.depth += 1
        inner = self.alternatives()
        self.depth -= 1
        if self.peek() != ")":
            raise self.error("syntax", "group has no closing parenthesis", start)
        self.i += 1
        return self.node(*make, inner)

    def hexadecimal(self, count: int) -> int:
        digits = self.peek(count)
        if not re.fullmatch(f"[0-9a-fA-F]{{{count}}}", digits):
            raise self.error("syntax", "invalid hexadecimal escape")
        self.i += count
        value = int(digits, 16)
        if 0xD800 <= value <= 0xDFFF:
            raise self.error("unsupported", "surrogate escape")
        return value

    def escaped(self, in_set: bool):
        """A code unit, or a set's letter, from what follows a backslash."""
        start = self.i
        self.i += 1
        c = self.peek()
        self.i += 1
        if not c:
            raise self.error("syntax", "dangling escape", start)
        if c in SETS:
            return c
        if c in CONTROLS:
            return CONTROLS[c]
        if c == "b" and in_set:
            return 8
        if c == "0":
            if self.peek().isascii() and self.peek().isdigit():
                raise self.error("syntax", "digit after \\0")
            return 0
        if c == "x":
            return self.hexadecimal(2)
        if c == "u":
            if self.peek() == "{":
                raise self.error("foreign", "code point escape", start)
            return self.hexadecimal(4)
        if c == "c":
            letter = self.peek()
            if not re.fullmatch("[A-Za-z]", letter):
                raise self.error("syntax", "control escape without a letter", start)
            self.i += 1
            return ord(letter) % 32
        if c in "pPAzCQE" or (c == "k" and (in_set or self.peek() == "<")):
            raise self.error("foreign", f"escape \\{c}", start)
        if c in "123456789":
            more = re.compile("[0-9]*").match(self.s, self.i)
            self.i = more.end()
            self.references.append((start, int((c + more[0])[:20])))
            return 0
        if not c.isascii() or c.isalnum() or c == "_":
            raise self.error("syntax", f"escape \\{c}", start)
        return ord(c)

    def escape(self):
        mark = self.peek(2)
        if mark == "\\b":
            self.i += 2
            return self.node("edge")
        if mark == "\\B":
            self.i += 2
            return self.node("noedge")
        got = self.escaped(False)
        return self.node("set", SETS[got]) if isinstance(got, str) else self.node("lit", (got,))

    def set_(self):
        start = self.i
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        ranges: list[tuple[int, int]] = []
        waiting: list[int] = []  # the second unit of a character that has two

        def one():
            if waiting:
                return waiting.pop()
            if self.peek() == "\\":
                return self.escaped(True)
            first, *rest = units(self.peek())
            waiting.extend(rest)
            self.i += 1
            return first

        while True:
            if not self.peek() and not waiting:
                raise self.error("syntax", "set has no closing bracket", start)
            if not waiting:
                if self.peek() == "]":
                    self.i += 1
                    break
                if self.peek(2) in ("&&", "[:"):
                    raise self.error("foreign", f"{self.peek(2)} in a set")
            left = one()
            if not waiting and self.peek() == "-" and self.peek(2)[1:] not in ("", "]"):
                dash = self.i
                if self.peek(2) == "--":
                    raise self.error("foreign", "-- in a set")
                self.i += 1
                right = one()
                if isinstance(left, str) or isinstance(right, str):
                    raise self.error("syntax", "a range's ends must be single characters", dash)
                if left > right:
                    raise self.error("syntax", "reversed range", dash)
                ranges.append((left, right))
            elif isinstance(left, str):
                ranges += SETS[left]
            else:
                ranges.append((left, left))
        found = merged(ranges)
        return self.node("set", complement(found) if negated else found)

    def count(self, start: int) -> int:
        m = re.compile("[0-9]+").match(self.s, self.i)
        if not m:
            raise self.error("syntax", "repeat without a count", start)
        self.i = m.end()
        if len(m[0].lstrip("0")) > 4 or int(m[0]) > MAX_REPEAT:
            raise self.error("complexity", "repeat count", start)
        return int(m[0])

    def repeat(self, item):
        start = self.i
        c = self.peek()
        self.i += 1
        low, high, counted = {"*": (0, None, False), "+": (1, None, False), "?": (0, 1, False)}.get(c, (0, 0, True))
        if counted:
            low = high = self.count(start)
            if self.peek() == ",":
                self.i += 1
                high = None if self.peek() == "}" else self.count(start)
                if high is not None and low > high:
                    raise self.error("syntax", "repeat minimum exceeds maximum", start)
            if self.peek() != "}":
                raise self.error("syntax", "counted repeat has no closing brace", start)
            self.i += 1
        lazy = self.peek() == "?"
        self.i += lazy
        if self.peek() and self.peek() in "*+?{":
            raise self.error("foreign" if self.peek() == "+" else "syntax", "repeated quantifier")
        found = self.node("rep", item, low, high, lazy, counted)
        if counted and product(found) > MAX_REPEAT:
            raise self.error("complexity", "nested repeat product", start)
        return found

    def place_looks(self, tree) -> None:
        if not self.looks:
            return
        fail = self.error("unsupported", "lookahead is only supported in a leading, anchored run", self.first_look)
        items = tree[1][0][1]
        if len(tree[1]) != 1 or len(items) < 2 or items[0][0] != "begin":
            raise fail
        run = 0
        for item in items[1:]:
            if item[0] != "look":
                break
            run += 1
            if run > MAX_ASSERTIONS:
                raise self.error("complexity", "leading assertions")
        if run != self.looks:
            raise fail
        if all(nullable(x) for x in items[1 + run :]):
            raise self.error("unsupported", "leading assertions need a consuming remainder", self.first_look)


def _inside(node) -> list:
    if node[0] in ("any", "seq"):
        return node[1]
    if node[0] == "rep":
        return [node[1]]
    return [node[-1]] if node[0] in ("group", "look") else []


def product(node) -> int:
    most = max([1, *(product(x) for x in _inside(node))])
    if node[0] == "rep" and node[5]:
        most *= max(1, node[2] if node[3] is None else node[3])
    return most


def nullable(node) -> bool:
    kind = node[0]
    if kind == "any":
        return any(nullable(x) for x in node[1])
    if kind == "seq":
        return all(nullable(x) for x in node[1])
    if kind == "group":
        return nullable(node[1])
    if kind == "rep":
        return node[2] == 0 or nullable(node[1])
    return kind not in ("lit", "set")


def _unit(u: int, java: bool) -> str:
    if 0xD800 <= u <= 0xDFFF:
        u = 0x10000 + u - 0xD800
    return f"\\x{{{u:x}}}" if java else f"\\U{u:08x}"


def _set(ranges: Ranges, java: bool) -> str:
    # surrogates lie elsewhere in rewritten subjects, so ranges are cut at their block
    parts = []
    for lo, hi in ranges:
        for a, b in ((0, 0xD7FF), (0xD800, 0xDFFF), (0xE000, TOP)):
            if max(lo, a) <= min(hi, b):
                parts.append((max(lo, a), min(hi, b)))
    if not parts:
        return "(?!)"
    return "[" + "".join(_unit(a, java) if a == b else f"{_unit(a, java)}-{_unit(b, java)}" for a, b in parts) + "]"


def render(node, java: bool = True) -> str:
    kind = node[0]
    if kind == "any":
        return "(?:" + "|".join(render(x, java) for x in node[1]) + ")"
    if kind == "seq":
        return "".join(render(x, java) for x in node[1])
    if kind == "lit":
        return "".join(_unit(u, java) for u in node[1])
    if kind == "set":
        return _set(node[1], java)
    if kind == "begin":
        return "\\A"
    if kind == "end":
        return "\\z" if java else "\\Z"
    if kind in ("edge", "noedge"):
        w = _set(WORD, java)
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))" if kind == "edge" else f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
    if kind == "group":
        return "(?:" + render(node[1], java) + ")"
    _, item, low, high, lazy, _ = node
    count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or f"{{{low},{'' if high is None else high}}}"
    head = ""
    if item[0] == "lit" and len(item[1]) > 1:  # without a Unicode mode, only the last unit repeats
        head, item = _unit(item[1][0], java), ("lit", item[1][1:])
    return f"{head}(?:{render(item, java)}){count}{'?' if lazy else ''}"


@dataclass(frozen=True)
class Pattern:
    """Checks that must all agree: (JVM expression, Python expression, whether it should match)."""

    source: str
    checks: tuple[tuple[str, str, bool], ...]
    ascii_only: bool = False
    native: bool = False
    _compiled: list = field(default_factory=list, compare=False, repr=False)

    def __reduce__(self):
        return Pattern, (self.source, self.checks, self.ascii_only, self.native)

    def matches(self, subject: str) -> bool:
        """Whether the pattern is found in the subject."""
        if self.ascii_only and not subject.isascii():
            return False
        if not self._compiled:
            self._compiled.extend((re.compile(p), want) for _, p, want in self.checks)
        if not self.native:
            subject = rewritten(subject)
        return all((c.search(subject) is not None) == want for c, want in self._compiled)

    def column(self, subject: Column) -> Column:
        """matches() of a string column, in JVM expressions alone."""

        def hold(s: Column) -> Column:
            found = None
            for java, _, want in self.checks:
                one = s.rlike(java) if want else ~s.rlike(java)
                found = one if found is None else found & one
            return found

        if self.ascii_only:
            return ~subject.rlike("[^\\x00-\\x7f]") & hold(subject)
        if self.native:
            return hold(subject)
        return F.when(subject.rlike("[\\x{10000}-\\x{10ffff}]"), hold(rewritten_column(subject))).otherwise(hold(subject))


def rewritten(subject: str) -> str:
    if subject.isascii() or max(subject) <= "￿":
        return subject
    return "".join("".join(chr(0x10000 + u - 0xD800) for u in units(c)) if ord(c) > TOP else c for c in subject)


def rewritten_column(subject: Column) -> Column:
    def one(c: Column) -> Column:
        over = F.ascii(c) - 0x10000
        hexed = lambda u: F.lpad(F.hex(u), 8, "0")
        pair = F.concat(hexed(F.lit(0x10000) + F.shiftright(over, 10)), hexed(F.lit(0x10400) + over.bitwiseAND(0x3FF)))
        return F.when(F.ascii(c) <= TOP, c).otherwise(F.decode(F.unhex(pair), "UTF-32"))

    return F.array_join(F.transform(F.regexp_extract_all(subject, F.lit("(?s)."), F.lit(0)), one), "")


def compile_pattern(source: str, reject_non_ascii: bool = False, use_native: bool = False) -> Pattern:
    """A pattern ready to match. use_native takes the JVM's own syntax, matched by code points."""
    size = len(source.encode("utf-8", "surrogatepass"))
    if size > MAX_SOURCE:
        raise PatternError("complexity", 0, "source is too long")
    if reject_non_ascii and not source.isascii():
        at = next(i for i, c in enumerate(source) if not c.isascii())
        raise PatternError("policy", len(source[:at].encode()), "non-ASCII pattern")
    if use_native:
        python = source.replace("\\z", "\\Z")
        try:
            re.compile(python)
        except re.error as e:
            raise PatternError("raw", e.pos or 0, str(e)) from None
        return Pattern(source, ((source, python, True),), reject_non_ascii, True)
    tree = _Parser(source).parse()
    if reject_non_ascii and _beyond_ascii(tree):
        raise PatternError("policy", 0, "non-ASCII pattern value")
    parts = checks_of(tree)
    checks = tuple((render(n), render(n, java=False), want) for n, want in parts)
    if sum(len(c[0]) for c in checks) > MAX_TEXT:
        raise PatternError("complexity", 0, "translated pattern is too long")
    return Pattern(source, checks, reject_non_ascii)


def checks_of(tree) -> list[tuple]:
    """A pattern's tree as trees without lookaheads, and whether each has to match."""
    items = tree[1][0][1]
    looks = []
    if items and items[0][0] == "begin":
        for item in items[1:]:
            if item[0] != "look":
                break
            looks.append(item)
    if not looks:
        return [(tree, True)]
    parts = [(("seq", [("begin",), ("group", x[2])]), x[1]) for x in looks]
    return [*parts, (("seq", [("begin",), ("group", ("any", [("seq", items[1 + len(looks) :])]))]), True)]


def _beyond_ascii(node) -> bool:
    if node[0] == "lit":
        return any(u > 127 for u in node[1])
    return any(_beyond_ascii(x) for x in _inside(node))
