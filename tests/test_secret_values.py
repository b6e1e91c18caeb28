"""Random values under names of secrets, and the keywords of all rules found in one pass."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from tarnfall.operators.detect.secret_rules import entropy, keyed_files, secret_rules


def bits(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def test_entropy(spark):
    texts = ["", "a", "aaaa", "abab", "abcdefgh", "é🙂é", "x" * 50 + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entropy(F.col("t")).alias("e")).collect()
    assert all(abs(r.e - bits(r.t)) < 1e-9 for r in rows)


def test_keywords(spark):
    files = spark.createDataFrame([("a", "xABCx"), ("b", "bc"), ("c", None), ("d", "abcd bc")], "rel string, content string")
    got = {(r.rel, r.rule_id) for r in keyed_files(files, {"one": ("abc", "zz"), "two": ("BC", "q"), "three": ("cd",)}).collect()}
    assert got == {("a", "one"), ("a", "two"), ("b", "two"), ("d", "one"), ("d", "two"), ("d", "three")}


def test_random_values(spark):
    value = "Zk3xQ9vB7mN2pL8w"
    rows = {
        "a.py": f'x = 1\nAPI_KEY_PROD = "{value}"', "b.yml": f"db:\n  password: '{value[:10]}'\n  pwd: 'aaaaaaaaaaaa'", "c.js": 'const tokenName = "aaaaaaaaaaaaaaaaaaaa"', "d.js": f'const id = "{value}"',
        "e.env": f"TOKEN={value}", "f.ts": "secretKey => 'sk_live_abcdefghij1234567'", "g.txt": "token", "h.md": None,
    }
    out = secret_rules(spark.createDataFrame([*rows.items()], "rel string, content string")).collect()
    assert sorted((r.file, r.start_line, r.rule_id, r.confidence) for r in out) == [("a.py", 2, "generic-token", "medium"), ("b.yml", 2, "generic-password", "medium"), ("f.ts", 1, "stripe-live-secret", "high")]
    assert not any(value in str(r) or value[:10] in str(r) for r in out)
