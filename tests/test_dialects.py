import re

import pytest

from palisade.functions.globs import to_regex
from palisade.functions.re2 import to_java


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("release/*", "release/1.2", True), ("release/*", "release/1/2", False), ("main", "mainline", False), ("src/auth/**", "src/auth/a/b.go", True),
        ("**/*.lock", "go.lock", True), ("**/*.lock", "a/b/go.lock", True), ("**/*.lock", "a/golock", False), ("a/{b,c}.go", "a/c.go", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a?c", "a/c", False),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.search(to_regex(glob).replace("\\z", "\\Z"), path)) is hit


@pytest.mark.parametrize("glob", ["[a", "{a", "a\\"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        to_regex(glob)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "(a)\\1", "a*+", "[a"])
def test_java_only_patterns(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)


def test_ascii_classes(spark):
    rows = [("#\x0bnoqa", False), ("# noqa", True), ("#noqa ", True)]
    df = spark.createDataFrame(rows, "s string, hit boolean")
    assert df.where(df["s"].rlike(to_java(r"#\s*noqa")) != df["hit"]).count() == 0
    ends = spark.createDataFrame([("pass ", False), ("pass\u0085", False), ("pass", True), ("éexcept:", False)], "s string, hit boolean")
    assert ends.where(ends["s"].rlike(to_java(r"pass\s*$")) != ends["hit"]).count() == 0
