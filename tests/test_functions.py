import random
import re

import pytest
from pyspark.sql import functions as F

from keystrata.functions.glob import glob_match, glob_regex, glob_to_regex
from keystrata.functions.keys import effective_key
from keystrata.functions.numbers import float_text, human_bytes, parse_float, parse_int, plain_float
from keystrata.functions.slots import crc16, crc32c, hash_tag, key_slot
from keystrata.operators.interpreter import slot_of

GLOBS = [
    ("*", "anything", True), ("*", "", True), ("user:*", "user:1", True), ("user:*", "usr:1", False), ("?ello", "hello", True), ("?", "", False),
    ("h[ae]llo", "hallo", True), ("h[ae]llo", "hillo", False), ("h[^e]llo", "hello", False), ("h[!e]llo", "hallo", True), ("h[a-c]llo", "hbllo", True),
    ("h[a-c]llo", "hdllo", False), ("*:end", "a:b:end", True), ("a*b*c", "aXXbYYc", True), ("a*b*c", "acb", False), ("**", "x\ny", True), ("[]x]a", "]a", True),
    ("[abc", "b", True), ("[abc", "d", False), ("[", "[", False), ("a.c", "abc", False), ("a$", "a$", True), ("(x)+", "(x)+", True), ("x", "x\n", False), ("", "", True), ("[z-a]", "m", False),
]


def glob_brute(p, s):
    """Whether s matches, by recursion on the pattern."""
    if not p:
        return not s
    if p[0] == "*":
        return any(glob_brute(p[1:], s[i:]) for i in range(len(s) + 1))
    if p[0] == "[":
        i = 1
        neg = p[i : i + 1] in ("^", "!")
        i += neg
        start, members = i, []
        while i < len(p) and (i == start or p[i] != "]"):
            if i + 2 < len(p) and p[i + 1] == "-":
                members.append((p[i], p[i + 2]))
                i += 3
            else:
                members.append((p[i], p[i]))
                i += 1
        return bool(s) and any(a <= s[0] <= b for a, b in members) != neg and glob_brute(p[i + 1 :], s[1:])
    return bool(s) and p[0] in ("?", s[0]) and glob_brute(p[1:], s[1:])


@pytest.mark.parametrize("pattern,text,expected", GLOBS)
def test_globs(spark, pattern, text, expected):
    df = spark.createDataFrame([(text, pattern)], "s string, p string")
    assert df.select(glob_match(F.col("s"), pattern)).first()[0] is expected
    assert df.select(F.rlike("s", glob_regex("p"))).first()[0] is expected


def test_globs_against_recursion():
    rng = random.Random(1)
    for _ in range(3_000):
        p = "".join(rng.choice("ab*?x") for _ in range(rng.randint(0, 6))) + rng.choice(["", "[ab]", "[^a]x", "[a-x]"])
        s = "".join(rng.choice("abx") for _ in range(rng.randint(0, 6)))
        assert bool(re.match(glob_to_regex(p)[:-1] + r"\Z", s)) == glob_brute(p, s), (p, s)


def test_slots(spark):
    known = {"123456789": (0x31C3, 12739), "": (0, 0), "foo": (44950, 12182)}
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "k string")
    got = {r.k: (r.c, r.s) for r in df.select("k", crc16(F.col("k")).alias("c"), key_slot(F.col("k")).alias("s")).collect()}
    assert got[None] == (None, None)
    assert got["123456789"] == known["123456789"] and got[""] == (0, 0) and got["foo"][1] == 12182


TAGS = {"{user1}.a": "user1", "a{b}c": "b", "{}x": "{}x", "plain": "plain", "a{b": "a{b", "{{x}}": "{x", "a}{b}": "b"}


def test_tags(spark):
    df = spark.createDataFrame(list(TAGS), "string")
    got = {r.value: (bytes(r.t).decode(), r.s) for r in df.select("value", hash_tag(F.col("value")).alias("t"), key_slot(F.col("value")).alias("s")).collect()}
    assert {k: t for k, (t, _) in got.items()} == TAGS
    assert all(slot_of(k.encode()) == s for k, (_, s) in got.items())


def test_binary_slots_and_spread(spark):
    rng = random.Random(2)
    keys = [rng.randbytes(rng.randint(1, 20)) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    assert all(slot_of(bytes(r.k)) == r.s for r in df.select("k", key_slot(F.col("k")).alias("s")).collect())
    many = spark.range(20_000).select(key_slot(F.concat(F.lit("key_"), F.col("id").cast("string"))).alias("s"))
    assert many.distinct().count() > 10_000


def test_crc32c(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",), (None,), (bytes(32),)], "b binary")
    assert [r.c for r in df.select(crc32c("b").alias("c")).collect()] == [0xE3069283, 0, None, 0x8A9136AA]


def test_numbers(spark):
    ints = {"12": 12, "+5": 5, "-7": -7, " 12": None, "12.0": None, "1e3": None, "": None, "9223372036854775808": None, "9223372036854775807": 2**63 - 1, "12\n": None, None: None}
    got = {r.s: r.v for r in spark.createDataFrame([(s,) for s in ints], "s string").select("s", parse_int(F.col("s")).alias("v")).collect()}
    assert got == ints
    floats = {"1.5": 1.5, "-.5": -0.5, "1e3": 1000.0, "inf": None, "nan": None, "1e999": None, "x": None, "1.": 1.0, "": None}
    got = {r.s: r.v for r in spark.createDataFrame([(s,) for s in floats], "s string").select("s", parse_float(F.col("s")).alias("v")).collect()}
    assert got == floats
    assert [plain_float(x) for x in (10.6, 1e10, 10.0, 1e-7, -0.5, 1e22)] == ["10.6", "10000000000", "10", "0.0000001", "-0.5", "10000000000000000000000"]
    assert [r[0] for r in spark.createDataFrame([(1e10,), (None,)], "x double").select(float_text("x")).collect()] == ["10000000000", None]
    sizes = {0: "0B", 1023: "1023B", 1536: "1.50K", 2 * 1024**2: "2.00M", 3 * 1024**3: "3.00G", None: None}
    assert {r.n: r.t for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", human_bytes(F.col("n")).alias("t")).collect()} == sizes


def test_effective_key(spark):
    rows = [(b"abcdef", 3, b"abc"), (b"abc", None, b"abc"), (b"abc", 9, b"abc"), (b"abc", 0, None), (b"abc", -1, None), (None, 2, None), (b"", None, None)]
    df = spark.createDataFrame(rows, "key binary, key_len int, want binary")
    assert all(r.got == r.want for r in df.select(effective_key(F.col("key"), F.col("key_len")).alias("got"), "want").collect())
