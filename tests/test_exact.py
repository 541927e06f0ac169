import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpact.functions.exact import JSONError, Num, canonical, digest, equal, flatten, parse


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1.0", "1"), ("0.001", "1e-3"), ("12345678901234567890.1250", "12345678901234567890.125"), ("10e999999999", "1e1000000000"),
        ("-0", "0"), ("-0.0e5", "0"), ("100", "100"), ("1000", "1e3"), ("0.1", "0.1"), ("1.5e-7", "15e-8"), ("-12.50", "-12.5"), (" 7 ", "7"),
    ],
)
def test_canonical_number(text, want):
    assert Num.parse(text).lexeme == want


@pytest.mark.parametrize("text", ["", "+1", "01", "1.", ".5", "1e", "0x1", "1 2", "--1"])
def test_bad_number(text):
    with pytest.raises(JSONError):
        Num.parse(text)


@settings(deadline=None, max_examples=200)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=6), st.decimals(allow_nan=False, allow_infinity=False, places=6))
def test_compare_like_decimals(a, b):
    x, y = Num.parse(format(a, "f")), Num.parse(format(b, "f"))
    assert x.compare(y) == (a > b) - (a < b)


@settings(deadline=None, max_examples=200)
@given(st.integers(-(10**12), 10**12), st.integers(1, 10**6), st.integers(-4, 6))
def test_multiples_like_fractions(a, b, e):
    from fractions import Fraction

    value, divisor = Num.parse(f"{a}e{e}"), Num.parse(str(b))
    assert value.is_multiple_of(divisor) == ((Fraction(a) * Fraction(10) ** e / b).denominator == 1)


def test_huge_exponents():
    assert Num.parse("1e100001").is_integer()
    assert not Num.parse("1e100001").is_multiple_of(Num.parse("3"))
    assert Num.parse("1e100001").is_multiple_of(Num.parse("2"))
    assert Num.parse("1e-400").fits_float(64) and not Num.parse("1e400").fits_float(64)
    assert Num.parse("3.4028235e38").fits_float(32) and not Num.parse("3.5e38").fits_float(32)
    long = "9" * 5000
    assert Num.parse(long).is_multiple_of(Num.parse("9"))


@pytest.mark.parametrize(
    "text",
    ["0xff", "true false", '{"a":1,"a":2}', '[{"a":1,"a":2}]', '"\\ud800"', '"\\udc00"', "[1,]", '{"a":1,}', "", "nul", '"\x01"', '{"\\u0061":1,"a":2}', "  "],
)
def test_strictness(text):
    with pytest.raises(JSONError):
        parse(text)


def test_invalid_utf8():
    with pytest.raises(JSONError):
        parse(b'"\xff"')


def test_values():
    a = parse(' {"b":[1.0,{"x":null}],"a":"<\\u00e9\\ud83d\\ude00\\n", "c":{} ,"d":[]} ')
    assert canonical(a) == '{"a":"\\u003cé😀\\n","b":[1,{"x":null}],"c":{},"d":[]}'
    b = parse('{"d":[],"c":{},"a":"<é😀\\n","b":[10e-1,{"x":null}]}')
    assert equal(a, b) and digest(a) == digest(b)
    assert not equal(a, parse("[]"))


def test_depth():
    assert canonical(parse("[" * 50000 + "]" * 50000)).startswith("[[[")


def test_nodes():
    found = [(n.pointer, n.kind, n.text, n.template) for n in flatten(parse('{"z/y":[true,"t"],"a~":null}'))]
    assert found == [
        ("#", "object", '{"a~":null,"z/y":[true,"t"]}', "#"),
        ("#/a~0", "null", "null", "#/a~0"),
        ("#/z~1y", "array", '[true,"t"]', "#/z~1y"),
        ("#/z~1y/0", "boolean", "true", "#/z~1y/*"),
        ("#/z~1y/1", "string", "t", "#/z~1y/*"),
    ]


def test_constructors():
    from sparkpact.functions.exact import JSONError, canonical, make_array, make_number, make_object, make_string

    inner = [make_number("1.0"), None]
    value = make_object([("b", make_array([True, inner])), ("a", make_string("é"))])
    inner.append(False)  # what was made stays as it was
    assert canonical(value) == '{"a":"é","b":[true,[1,null]]}' or canonical(value) == '{"b":[true,[1,null]],"a":"é"}'
    for bad in (lambda: make_object([("a", 1), ("a", 2)]), lambda: make_string("\ud800"), lambda: make_object([("\udfff", 1)]), lambda: make_number("01")):
        with pytest.raises(JSONError):
            bad()
