import pytest
from pyspark.sql import functions as F

from sparkpact.functions.formats import format_column, matches_format
from sparkpact.functions.patterns import PatternError, compile_pattern

CASES = [
    ("", "anything", True), ("b", "abc", True), ("c$", "abc\n", False), ("^(?:x|)$", "", True), ("^x{2,3}?$", "xxx", True),
    ("^.$", " ", False), ("^.$", "😀", False), ("^..$", "😀", True), ("^.{2}$", "😀", True),
    (r"^\s$", "᠎", True), (r"^\s$", "​", True), (r"^\s$", " ", False), (r"^\d$", "٧", False), (r"^\w$", "é", False),
    (r"\bdog\b", "dog!", True), (r"\bdog\b", "dogma", False), (r"x\By", "xy", True), (r"\bx", "éx", True),
    ("[😀]", "😀", True), ("[x-😀]", "", False), ("[😀-\\uFFFF]", "", True), ("^[😀]$", "😀", False), ("[^😀]", "😀", False),
    ("^😀{2}$", "😀😀", False), ("^😀?$", "", False), ("^(?:😀){2}$", "😀😀", True), (r"^[\b]$", "\b", True), (r"^[\D_]$", "7", False),
    ("[]", "x", False), ("^[^]$", "\n", True), (r"^\x41b\cC\0$", "Ab\x03\x00", True), (r"^\/\-\#$", "/-#", True),
    ("^(?=x)xy", "xyz", True), ("^(?!xy)x", "xy", False), ("^(?=x)(?!xy)x", "xz", True), ("^[a-z0-9-_.]+$", "a-_.9", True),
]


@pytest.mark.parametrize(("pattern", "subject", "want"), CASES)
def test_python(pattern, subject, want):
    assert compile_pattern(pattern).matches(subject) is want


def test_jvm(spark):
    df = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(CASES)], "i int, s string")
    each = [F.max(F.when(F.col("i") == i, compile_pattern(p).column(F.col("s")))).alias(f"c{i}") for i, (p, _, _) in enumerate(CASES)]
    assert list(df.agg(*each).first()) == [w for *_, w in CASES]


@pytest.mark.parametrize(
    ("pattern", "kind"),
    [
        ("(", "syntax"), ("a)", "syntax"), ("[a", "syntax"), ("a**", "syntax"), ("a{2", "syntax"), ("a{3,2}", "syntax"), (r"\1", "syntax"), (r"\q", "syntax"),
        ("a{1001}", "complexity"), ("(?:a{50}){50}", "complexity"), ("(" * 101 + ")" * 101, "complexity"), ("a" * 70000, "complexity"),
        (r"(a)\1", "unsupported"), ("(?=a)", "unsupported"), ("a(?=b)", "unsupported"), ("^(?=a)", "unsupported"), (r"\ud800", "unsupported"),
        (r"\p{L}", "foreign"), (r"\u{61}", "foreign"), ("(?<a>b)", "foreign"), ("a++", "foreign"), ("[a&&b]", "foreign"), ("[[:alpha:]]", "foreign"), ("(?>a)", "foreign"),
    ],
)
def test_refused(pattern, kind):
    with pytest.raises(PatternError) as e:
        compile_pattern(pattern)
    assert e.value.kind == kind


def test_ascii_policy():
    with pytest.raises(PatternError) as e:
        compile_pattern("é", reject_non_ascii=True)
    assert e.value.kind == "policy"
    assert not compile_pattern("x", reject_non_ascii=True).matches("xé")
    assert compile_pattern("^.$", use_native=True).matches("😀")


FORMATS = {
    "uuid": (["a1234567-1234-4234-8234-123456789abc"], ["a1234567-1234-1234-8234-123456789abc", "{a1234567-1234-4234-8234-123456789abc}"]),
    "byte": (["", "YQ==", "YWI=", "+///"], ["%%%", "YQ", "YR==", "YWJ="]),
    "ipv4": (["0.0.0.0", "255.255.255.255"], ["010.0.0.1", "256.0.0.1", "1.2.3"]),
    "cidr": (["192.0.2.7/24"], ["192.0.2.7/33", "1.1.1.1/00"]),
    "date": (["0000-02-29", "2024-02-29"], ["1900-02-29", "2024-02-30", "2026-07-14\n"]),
    "date-time": (["2026-07-14T12:30:00Z", "2024-02-29T23:59:59.5+01:00"], ["2026-07-14T24:00:00Z", "2026-07-14t12:30:00z"]),
    "email": (
        ["first.last@example.com", '"a b"@x', "p@[192.0.2.1]", "p@[IPv6:2001:db8::1]", "p@[TAG:v]", "a" * 64 + "@x", "a@" + "b" * 63],
        ["a..b@x", "a@-x", "a@[256.0.0.1]", "a@[IPv6:2001:::1]", "a" * 65 + "@x", "a@" + "b" * 64, "é@x"],
    ),
}


def test_formats(spark):
    rows = [(f, v, w) for f, (good, bad) in FORMATS.items() for w, values in ((True, good), (False, bad)) for v in values]
    assert [(f, v) for f, v, w in rows if matches_format(f, v) is not w] == []
    df = spark.createDataFrame(rows, "f string, v string, w boolean")
    got = F.coalesce(*[F.when(F.col("f") == f, format_column(f, F.col("v"))) for f in FORMATS])
    assert df.filter(got != F.col("w")).collect() == []
    assert matches_format("password", "anything")
