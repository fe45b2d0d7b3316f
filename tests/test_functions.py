import pytest
from pyspark.sql import functions as F

from lattiq.functions import globs, paths
from lattiq.functions.hashes import fnv1a, fnv1a_text

KNOWN = "ARCH-001|source=apps/web/src/shared/format.ts|target=apps/web/src/shared/currency.ts", "e70698973839db1d"


@pytest.mark.parametrize(
    ("glob", "path", "plain", "crossing"),
    [
        ("src/shared/*.ts", "src/shared/util.ts", True, True),
        ("src/shared/*.ts", "src/shared/deep/util.ts", False, True),
        ("**/*.ts", "a.ts", True, True),
        ("**/*.ts", "x/y/a.ts", True, True),
        ("src/**", "src/a/b.ts", True, True),
        ("src/**", "src", False, False),
        ("a?.{ts,tsx}", "ab.tsx", True, True),
        ("a?.{ts,tsx}", "a/.ts", False, True),
        ("[!a-c]x", "dx", True, True),
        ("[a-c]x", "dx", False, False),
        ("node:*", "node:fs", True, True),
        ("@scope/ui", "@scope/ui", True, True),
        ("a.b+c", "a.b+c", True, True),
        ("a.b", "axb", False, False),
    ],
)
def test_globs(glob, path, plain, crossing):
    assert globs.match(path, [glob]) is plain
    assert globs.match(path, [glob], True) is crossing


def test_unclosed_glob():
    with pytest.raises(ValueError, match="unclosed"):
        globs.regex_of("a{b")


def test_hash(spark):
    texts = [KNOWN[0], "", "é日本", "a" * 300]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {t: fnv1a_text(t) for t in texts}
    assert got[KNOWN[0]] == KNOWN[1]


def test_paths(spark):
    rows = [("a/b/../c/./d",), ("../x",), ("a\\b",), ("",)]
    df = spark.createDataFrame(rows, "p string")
    n = [r[0] for r in df.select(paths.normal(F.col("p"))).collect()]
    assert n == ["a/c/d", "x", "a/b", ""]
    one = spark.createDataFrame([("apps/web/src/a.test.ts", "@s/n/x")], "p string, s string").select(paths.parent(F.col("p")).alias("up"), paths.stem(F.col("p")).alias("stem"), paths.extension(F.col("p")).alias("ext"), paths.package_name(F.col("s")).alias("pkg"), paths.ancestors(F.col("p")).alias("all"), paths.depth(F.col("p")).alias("d")).first()
    assert (one.up, one.stem, one.ext, one.pkg, one.d) == ("apps/web/src", "a", "ts", "@s/n", 4)
    assert one.all == ["", "apps", "apps/web", "apps/web/src"]
