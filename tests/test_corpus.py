from pyspark.sql import functions as F

from gaugeworks.functions import keys
from gaugeworks.operators import corpus


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return df.select(expr.alias("x")).collect()[0].x


def test_keys(spark):
    u, n = F.col("u"), F.col("n")
    assert one(spark, keys.tool_key(u, n), u="r::q::f:1", n="q") == "r::q::f:1::q"
    assert one(spark, keys.tool_key(u, n), u="r::q::f:1::q", n="q") == "r::q::f:1::q"
    assert one(spark, keys.tool_key(u, n.cast("string")), u="r", n=None) == "r"
    assert one(spark, keys.slug_of_repo(u), u="a/b/c") == "a__b/c"
    assert one(spark, keys.safe_file_name(u), u="é a/b-1_.x") == "é_a_b-1_.x"
    assert one(spark, keys.truncate_with_notice(u, 3, "!"), u="abcd") == "abc!"
    assert one(spark, keys.first_json_object(u), u='x {"a": {}} y') == '{"a": {}}'
    assert one(spark, keys.mask_secret(u), u="secret") == "secr…"
    assert one(spark, keys.seconds_of_duration(u), u="1.500s") == 1.5 and one(spark, keys.seconds_of_duration(u), u="x") is None
    line = lambda a, b: one(spark, keys.line_slice(u, F.lit(a), F.lit(b)), u="1\r\n2\n3")
    assert (line(2, 3), line(3, 9), line(5, 6), line(0, 1)) == ("2\n3", "3", "", None)


def test_shard_equals_python(spark):
    import hashlib

    for k in (1, 7, 10):
        assert one(spark, keys.shard_for(F.col("u"), k), u="tool") == int(hashlib.sha256(b"tool").hexdigest(), 16) % k


def test_allocation(spark):
    df = spark.createDataFrame([("a", 50), ("b", 2), ("c", 30)], "stratum string, size int")
    assert {r.stratum: r.alocado for r in corpus.stratum_allocation(df, 10).collect()} == {"a": 4, "b": 2, "c": 3}


def test_log_bins_of_equal_values_and_empty(spark):
    df = spark.createDataFrame([(5,), (5,)], "v int")
    assert [tuple(r) for r in corpus.log_bins(df, F.col("v"), 4).collect()] == [(1, 2)]
    assert corpus.log_bins(df.limit(0), F.col("v"), 4).collect() == []
    assert corpus.distribution(df.limit(0), F.col("v"), "x").collect() == []


def test_paths(spark):
    rows = [(p,) for p in ("src/a.py", "Tests/a.py", "a/test_x.py", "a/x_test.go", "a/b.spec.ts", "x.py", "a/test.py/x.go", "latest/x.py")]
    got = {r.file_path for r in corpus.source_file_filter(spark.createDataFrame(rows, "file_path string")).collect()}
    # Only Python's and the TypeScript and JavaScript forms of test names count.
    assert got == {"src/a.py", "x.py", "a/x_test.go", "a/test.py/x.go", "latest/x.py"}
    more = {"testing/a.py": 0, "conformance-tests/a.ts": 0, "docs_src/a.py": 0, "Sample/a.go": 0, "fixtures/a.go": 1, "target/a.rs": 1, "a/B.TEST.TS": 0, "a/c_test.py": 0, "a/Test_c.py": 0, "a/test_c.PY": 1, "a/contest.py": 1, "a/x.spec.mjs": 0, "a/xTest.java": 1, "examples": 1}
    got = {r.file_path for r in corpus.source_file_filter(spark.createDataFrame([(p,) for p in more], "file_path string")).collect()}
    assert got == {p for p, keep in more.items() if keep}


def test_slug_scientific_and_rounding(spark):
    import re
    import unicodedata

    for t in ("Análise Geral – Ç/ß x_1", "--Ünïcödé--", "", "Ｆｕｌｌ ½ 数", "ŁØ"):
        want = re.sub(r"[^a-zA-Z0-9]+", "_", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).strip("_").lower()
        if "½" not in t:
            assert one(spark, keys.ascii_slug(F.col("u")), u=t) == want, t
    assert one(spark, keys.scientific(F.col("u")), u=0.00123) == r"$1,23 \times 10^{-3}$" and one(spark, keys.scientific(F.col("u")), u=0.0) == "$< 10^{-300}$"
    df = spark.createDataFrame([((1.23456, [2.00051, None], {"a": 0.0005}), 7, None), (None, 8, 1.5)], "s struct<x:double,y:array<double>,z:map<string,double>>, n int, d double")
    rows = [r.asDict(recursive=True) for r in keys.rounded(df).collect()]
    assert rows == [{"s": {"x": 1.235, "y": [2.001, None], "z": {"a": 0.0}}, "n": 7, "d": None}, {"s": None, "n": 8, "d": 1.5}]


def test_lines_end_as_in_unicode(spark):
    text = "a\u2028b\rc\r\nd\n\x0ce\n"
    for a, b in ((1, 9), (2, 3), (4, 6), (6, 6), (7, 9)):
        want = "\n".join(text.splitlines()[a - 1 : b])
        assert one(spark, keys.line_slice(F.col("u"), F.lit(a), F.lit(b)), u=text) == want
