"""The closed set of string formats, as anchored regular expressions.

The expressions keep to what the JVM's and Python's engines read alike.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats' grammars.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|0)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_DATE = (
    "(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    f"|02-(?:0[1-9]|1[0-9]|2[0-8]))|{_LEAP}-02-29)"
)
_HOUR = "(?:[01][0-9]|2[0-3])"
_UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-4[0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}"
_CIDR = f"{_IPV4}/(?:3[0-2]|[12][0-9]|[0-9])"

# The grammar of addresses in RFC 5321 and RFC 4291.
_ATOM = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LOCAL = rf'(?:{_ATOM}(?:\.{_ATOM})*|"(?:[\x20\x21\x23-\x5B\x5D-\x7E]|\\[\x20-\x7E])*")'
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_SNUM = "(?:25[0-5]|2[0-4][0-9]|[01][0-9]{2}|[0-9]{1,2})"
_MAIL4 = rf"{_SNUM}(?:\.{_SNUM}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"


def _groups(least: int, most: int) -> str:
    """Between `least` and `most` groups with colons between them."""
    if most == 0:
        return ""
    some = f"{_H}(?::{_H}){{{max(least - 1, 0)},{most - 1}}}"
    return some if least else f"(?:{some})?"


def _ipv6() -> str:
    # '::' stands for two groups at least; with an IPv4 tail six groups are spelled at most, four beside '::'
    forms = [_groups(8, 8), f"{_groups(6, 6)}:{_MAIL4}"]
    forms += [f"{_groups(left, left)}::{_groups(0, 6 - left)}" for left in range(7)]
    forms += [f"{_groups(left, left)}::(?:{_groups(1, 4 - left)}:)?{_MAIL4}" if left < 4 else f"{_groups(4, 4)}::{_MAIL4}" for left in range(5)]
    return "(?:" + "|".join(forms) + ")"


_LITERAL = rf"\[(?:{_MAIL4}|[Ii][Pp][Vv]6:{_ipv6()}|(?![Ii][Pp][Vv]6:)[A-Za-z0-9-]*[A-Za-z0-9]:[!-Z^-~]+)\]"

FORMATS = {
    "uuid": _UUID,
    "uuidv4": _UUID,
    "uuid-v4": _UUID,
    "ipv4": _IPV4,
    "cidr": _CIDR,
    "ipv4-cidr": _CIDR,
    "byte": "(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?",
    "date": _DATE,
    "date-time": rf"{_DATE}T{_HOUR}:[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-]{_HOUR}:[0-5][0-9])",
}
#: Its first group is the local part, of 64 characters at most.
_EMAIL_BODY = rf"({_LOCAL})@(?:{_LABEL}(?:\.{_LABEL})*|{_LITERAL})"
#: Formats of numbers, and that of strings which checks nothing.
NUMERIC, INERT = ("int32", "int64", "float", "double"), ("password",)
STRING = (*FORMATS, "email")


@functools.lru_cache(maxsize=None)
def _compiled(name: str):
    return re.compile(_EMAIL_BODY if name == "email" else FORMATS[name])


def matches_format(name: str, value: str) -> bool:
    if name in INERT:
        return True
    m = _compiled(name).fullmatch(value)
    return m is not None and (name != "email" or len(m[1]) <= 64 and len(value) <= 254)


def format_column(name: str, value: Column) -> Column:
    """matches_format() of a string column."""
    if name in INERT:
        return F.lit(True)
    if name != "email":
        return value.rlike(rf"\A(?:{FORMATS[name]})\z")
    whole = rf"\A{_EMAIL_BODY}\z"
    return value.rlike(whole) & (F.length(F.regexp_extract(value, whole, 1)) <= 64) & (F.length(value) <= 254)
