"""Exact JSON: strict parsing, decimal numbers of any size, canonical text, equality, hash.

A parsed value is a plain Python object: None, bool, str, Num, list, or dict (a dict's
order is that of the text; names are unique). Parsing is strict: UTF-8, one value, no text
after it, no repeated names in an object, no lone surrogates. The parser keeps its own
stack, so depth is bounded by memory alone.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction
from functools import total_ordering
from typing import Any

_NUMBER = re.compile(r"(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?")
_SPACE = " \t\n\r"


class JSONError(ValueError):
    """The text is not strict JSON."""


@total_ordering
@dataclass(frozen=True)
class Num:
    """A decimal number: sign, digits without outer zeros, and a power of ten. Zero is ('', '0', 0)."""

    sign: str
    digits: str
    exp: int

    @classmethod
    def parse(cls, text: str) -> Num:
        """The number that JSON text spells; white space around it is passed over."""
        m = _NUMBER.fullmatch(text.strip(_SPACE))
        if not m:
            raise JSONError(f"invalid number {text[:64]!r}")
        sign, whole, part, power = m.groups()
        digits = (whole + (part or "")).lstrip("0")
        exp = _int(power or "0") - len(part or "")
        short = digits.rstrip("0")
        if not short:
            return cls("", "0", 0)
        return cls(sign, short, exp + len(digits) - len(short))

    @classmethod
    def of(cls, value: int) -> Num:
        return cls.parse(str(value))

    @property
    def lexeme(self) -> str:
        """The canonical spelling: plain, or digits and exponent where that is shorter."""
        d, e = self.digits, self.exp
        if d == "0":
            return "0"
        size = len(d)
        point = size + e  # digits before the point
        scientific = d + (f"e{e}" if e else "")
        plain_size = point if e >= 0 else (size + 1 if point > 0 else size + 2 - point)
        if plain_size > len(scientific):
            return self.sign + scientific
        if e >= 0:
            plain = d + "0" * e
        elif point > 0:
            plain = d[:point] + "." + d[point:]
        else:
            plain = "0." + "0" * -point + d
        return self.sign + plain

    @property
    def mag(self) -> int:
        """Digits before the point of the spelled-out number; orders positive numbers with digits."""
        return self.exp + len(self.digits)

    def _key(self) -> int:
        return 0 if self.digits == "0" else (-1 if self.sign else 1)

    def compare(self, other: Num) -> int:
        a, b = self._key(), other._key()
        if a != b or not a:
            return (a > b) - (a < b)
        x, y = (self.mag, self.digits), (other.mag, other.digits)
        return ((x > y) - (x < y)) * a

    def __lt__(self, other: Num) -> bool:
        return self.compare(other) < 0

    def is_integer(self) -> bool:
        return self.exp >= 0

    def is_multiple_of(self, divisor: Num) -> bool:
        """Whether the quotient is an integer, whatever the exponents."""
        if divisor.digits == "0":
            raise ValueError("divisor must not be zero")
        if self.digits == "0":
            return True
        e = self.exp - divisor.exp
        if e < 0:  # as digits don't end in 0, 10 doesn't divide them
            return False
        rest = Fraction(_int(self.digits), _int(divisor.digits)).denominator
        return _divides_power_of_ten(rest, e)

    def fits_float(self, bits: int) -> bool:
        """Whether rounding to IEEE-754 of that size gives a finite number."""
        limit = 2**128 - 2**103 if bits == 32 else 2**1024 - 2**970
        return Num("", self.digits, self.exp) < Num.of(limit)

    def in_range(self, low: int, high: int) -> bool:
        return Num.of(low) <= self <= Num.of(high)


def _int(text: str) -> int:
    """int(), of any length."""
    if len(text) <= 4000:
        return int(text)
    sign, digits = (-1, text[1:]) if text[0] == "-" else (1, text.lstrip("+"))
    half = len(digits) // 2
    return sign * (_int(digits[:half]) * 10 ** (len(digits) - half) + _int(digits[half:]))


def _divides_power_of_ten(n: int, e: int) -> bool:
    """Whether n divides 10**e."""
    twos = (n & -n).bit_length() - 1
    n >>= twos
    fives = 0
    while n % 5 == 0:
        n //= 5
        fives += 1
    return n == 1 and max(twos, fives) <= e


@dataclass(frozen=True)
class Node:
    """A value's place in a flattened document."""

    pointer: str
    parent: str | None
    name: str | None
    index: int | None
    kind: str
    text: str
    #: the pointer with '*' for each array index
    template: str


_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def fail(self, what: str) -> JSONError:
        return JSONError(f"{what} at offset {self.i}")

    def space(self) -> None:
        s, i, n = self.s, self.i, len(self.s)
        while i < n and s[i] in _SPACE:
            i += 1
        self.i = i

    def string(self) -> str:
        """The string whose opening quote is next."""
        self.i += 1
        out = []
        while True:
            m = _PLAIN.match(self.s, self.i)
            out.append(m[0])
            self.i = m.end()
            c = self.s[self.i : self.i + 1]
            if c == '"':
                self.i += 1
                return "".join(out)
            if c != "\\":
                raise self.fail("unterminated string" if not c else "control character in string")
            e = self.s[self.i + 1 : self.i + 2]
            if e == "u":
                out.append(self.unicode())
            elif e in _ESCAPES and e:
                out.append(_ESCAPES[e])
                self.i += 2
            else:
                raise self.fail("invalid escape")

    def unit(self) -> int:
        four = self.s[self.i + 2 : self.i + 6]
        if not re.fullmatch("[0-9a-fA-F]{4}", four):
            raise self.fail("invalid unicode escape")
        self.i += 6
        return int(four, 16)

    def unicode(self) -> str:
        u = self.unit()
        if 0xDC00 <= u <= 0xDFFF:
            raise self.fail("lone surrogate")
        if 0xD800 <= u <= 0xDBFF:
            if self.s[self.i : self.i + 2] != "\\u":
                raise self.fail("lone surrogate")
            v = self.unit()
            if not 0xDC00 <= v <= 0xDFFF:
                raise self.fail("lone surrogate")
            return chr(0x10000 + ((u - 0xD800) << 10) + (v - 0xDC00))
        return chr(u)

    def scalar(self) -> Any:
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.s.startswith(word, self.i):
                self.i += len(word)
                return value
        m = _NUMBER.match(self.s, self.i)
        if not m:
            raise self.fail("invalid value" if self.i < len(self.s) else "unexpected end")
        self.i = m.end()
        return Num.parse(m[0])

    def name(self, seen: dict) -> str:
        if self.s[self.i : self.i + 1] != '"':
            raise self.fail("expected a member name")
        name = self.string()
        if name in seen:
            raise self.fail(f"duplicate member {name!r}")
        self.space()
        if self.s[self.i : self.i + 1] != ":":
            raise self.fail("expected a colon")
        self.i += 1
        self.space()
        return name

    def document(self) -> Any:
        self.space()
        root: list = []
        stack: list[tuple[Any, str | None]] = [(root, None)]  # containers under way, and the member to fill
        while True:
            c = self.s[self.i : self.i + 1]
            opened = False
            if c == "{":
                value, opened = {}, True
            elif c == "[":
                value, opened = [], True
            elif c == '"':
                value = self.string()
            else:
                value = self.scalar()
            box, name = stack[-1]
            if name is None:
                box.append(value)
            else:
                box[name] = value
            if opened:
                self.i += 1
                self.space()
                if self.s[self.i : self.i + 1] == ("}" if c == "{" else "]"):
                    self.i += 1
                else:
                    stack.append((value, self.name(value) if c == "{" else None))
                    continue
            # close what ends here, or go on to the next element
            while len(stack) > 1:
                self.space()
                box, name = stack[-1]
                c = self.s[self.i : self.i + 1]
                if c == ",":
                    self.i += 1
                    self.space()
                    if name is not None:
                        stack[-1] = (box, self.name(box))
                    break
                if c != ("]" if name is None else "}"):
                    raise self.fail("expected a comma or the end of the container")
                self.i += 1
                stack.pop()
            else:
                self.space()
                if self.i != len(self.s):
                    raise self.fail("text after the value")
                return root[0]


def make_number(text: str) -> Num:
    """A JSON number from its text."""
    return Num.parse(text)


def make_string(text: str) -> str:
    """A JSON string; lone surrogates are refused."""
    try:
        text.encode()
    except UnicodeEncodeError:
        raise JSONError("lone surrogate in a string") from None
    return text


def make_array(values: Iterable[Any]) -> list:
    """A JSON array that shares no list or object with its elements."""
    return [copy.deepcopy(v) for v in values]


def make_object(members: Iterable[tuple[str, Any]]) -> dict:
    """A JSON object from names and values; repeated names are refused."""
    out: dict[str, Any] = {}
    for name, value in members:
        if make_string(name) in out:
            raise JSONError(f"duplicate member {name!r}")
        out[name] = copy.deepcopy(value)
    return out


def parse(text: str | bytes) -> Any:
    """The value of strict JSON text."""
    if isinstance(text, bytes):
        try:
            text = text.decode("utf-8")
        except UnicodeDecodeError:
            raise JSONError("invalid UTF-8") from None
    return _Reader(text).document()


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Num):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


_QUOTED = {
    '"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t",
    "<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029",
}
_TO_QUOTE = re.compile('["\\\\\x00-\x1f<>&\u2028\u2029]')


def quote(text: str) -> str:
    """A JSON string; <, >, & and the two line separators are escaped too."""
    return '"' + _TO_QUOTE.sub(lambda m: _QUOTED.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def canonical(value: Any) -> str:
    """Names in byte order, canonical numbers, no white space. Equal values have equal canonical texts."""
    out: list[str] = []
    todo: list[Any] = [(value, False)]
    while todo:
        v, raw = todo.pop()
        if raw:
            out.append(v)
        elif isinstance(v, list):
            out.append("[")
            todo.append(("]", True))
            for i, x in reversed(list(enumerate(v))):
                todo.append((x, False))
                if i:
                    todo.append((",", True))
        elif isinstance(v, dict):
            out.append("{")
            todo.append(("}", True))
            for i, name in reversed(list(enumerate(sorted(v, key=str.encode)))):
                todo.append((v[name], False))
                todo.append((("," if i else "") + quote(name) + ":", True))
        elif isinstance(v, str):
            out.append(quote(v))
        elif isinstance(v, Num):
            out.append(v.lexeme)
        else:
            out.append("null" if v is None else "true" if v else "false")
    return "".join(out)


def equal(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def digest(value: Any) -> str:
    """SHA-256 of the canonical text, in hex."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def escape_token(token: str) -> str:
    """A JSON Pointer's token."""
    return token.replace("~", "~0").replace("/", "~1")


def flatten(value: Any) -> list[Node]:
    """Every value of a document, a container before what it holds, members in byte order."""
    out: list[Node] = []
    todo: list[tuple] = [(value, "#", None, None, None, "#")]
    while todo:
        v, pointer, parent, name, index, shape = todo.pop()
        out.append(Node(pointer, parent, name, index, kind_of(v), v if isinstance(v, str) else canonical(v), shape))
        if isinstance(v, list):
            todo += [(x, f"{pointer}/{i}", pointer, None, i, f"{shape}/*") for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            for n in sorted(v, key=str.encode, reverse=True):
                token = escape_token(n)
                todo.append((v[n], f"{pointer}/{token}", pointer, n, None, f"{shape}/{token}"))
    return out
