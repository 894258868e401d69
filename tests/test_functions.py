import pytest
from pyspark.sql import functions as F

from loomdex.functions import text, udf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("column", "want"), [
    (lambda: text.fold_ascii(F.lit("ÉA")), "Éa"), (lambda: text.flatten(F.lit(" a\r\n\t b\u00a0c ")), "a b c"), (lambda: text.module_name(F.lit("src/a/__init__.py")), "src.a"), (lambda: text.module_name(F.lit("src/a/b.py")), "src.a.b"),
    (lambda: text.script_module(F.lit("src/a.test.tsx")), "src/a.test"), (lambda: text.module_prefix(F.lit("a/b.go")), "a.b"), (lambda: text.last_segment(F.lit("a.b.c")), "c"), (lambda: text.language_of(F.lit("x/Y.MJS")), "javascript"), (lambda: text.language_of(F.lit("x/y.txt")), None),
    (lambda: text.signature_shape(F.lit("def load(load_x, load)"), F.lit("load")), "def (load_x, load)"), (lambda: text.signature_shape(F.lit("def a$b(x)"), F.lit("a$b")), "def (x)"), (lambda: text.signature_shape(F.lit("x"), F.lit("")), "x"),
    (lambda: text.normal_body(F.lit("a\r\nb\rc")), "a\nb\nc"), (lambda: text.role_of(F.lit("Src\\Services\\x.py")), "service"), (lambda: text.role_of(F.lit("tests/x.py")), "test"), (lambda: text.role_of(F.lit("lib/x.py")), "module"), (lambda: text.role_of(F.lit("x/__main__.py")), "entry"),
    (lambda: text.estimate_tokens(F.lit("中文ab")), 3), (lambda: text.estimate_tokens(F.lit(None).cast("string")), 0), (lambda: text.estimate_tokens(F.lit("abcd")), 2), (lambda: text.page_cost(F.lit("abc")), 25), (lambda: text.page_cost(F.lit("abc"), F.lit(True)), 24),
    (lambda: text.slug(F.lit("2024-01-02 Hello, World!")), "hello-world"), (lambda: text.slug(F.lit("!!")), "plan"), (lambda: text.repo_path(F.lit(" a\\b//c/ ")), "a/b/c"), (lambda: text.repo_path(F.lit("./a/./b")), "a/b"), (lambda: text.repo_path(F.lit("/a")), None), (lambda: text.repo_path(F.lit("C:/a")), None),
    (lambda: text.repo_path(F.lit("a/../b")), None), (lambda: text.repo_path(F.lit(" ")), None), (lambda: text.top_module(F.lit("a/b")), "a"), (lambda: text.top_module(F.lit("a")), "(root)"), (lambda: text.detail_name(F.lit("(root)")), "root-" + __import__("hashlib").md5(b"(root)").hexdigest()[:8] + ".md"),
    (lambda: text.label(F.lit("- a[b]: c")), "a b c"), (lambda: text.label(F.lit("()")), "item"), (lambda: text.label(F.lit("x" * 60)), "x" * 47 + "…"), (lambda: text.is_file_page(F.lit("x.go")), True), (lambda: text.is_file_page(F.lit("a.b")), False),
    (lambda: text.lexical_tokens(F.lit("Get_User by id, get_user ab")), ["get_user"]), (lambda: text.path_list(F.array(F.lit(" b\\c/ "), F.lit("a"), F.lit(""), F.lit("a/"))), ["a", "b/c"]), (lambda: text.scope_key(F.lit("s"), F.lit(None).cast("string"), F.lit("b")), '["s","","b"]'),
    (lambda: text.impact_confidence(F.lit(2)), 0.7), (lambda: text.impact_confidence(F.lit(9)), 0.35), (lambda: text.json_tokens(F.lit("")), 1), (lambda: text.json_tokens(F.lit("é" * 8)), 4), (lambda: text.kind_label(F.lit("method"), "zh"), "方法"), (lambda: text.kind_label(F.lit("odd")), "odd"),
    (lambda: text.description(F.lit("\n  First. \nmore"), F.lit("class"), F.lit("A"), F.lit(3), F.lit("")), "First."), (lambda: text.description(F.lit(""), F.lit("function"), F.lit("f"), F.lit(3), F.lit("int")), "Function f defined at line 3, returns int."), (lambda: text.description(F.lit(None).cast("string"), F.lit("class"), F.lit("A"), F.lit(3), F.lit(""), "zh"), "类 A，定义于第 3 行。"),
    (lambda: text.engineering_profile(F.lit("Rotate the API token"))["profile"], "production"), (lambda: text.engineering_profile(F.lit("public schema"))["boundaries"], ["public-api"]), (lambda: text.engineering_profile(F.lit("tidy"))["boundaries"], []),
    (lambda: text.iso(F.lit("2024-01-02 03:04:05.678901").cast("timestamp"), "ms"), "2024-01-02T03:04:05.678+00:00"),
])
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


def test_scores(spark):
    now, hour = F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit("2024-01-01 09:00:00").cast("timestamp")
    assert one(spark, text.recency(hour, now)) == 0.5 and one(spark, text.recency(now, hour)) == 1.0 and one(spark, text.recency(F.lit(None).cast("timestamp"), now)) == 0.0
    near = lambda *a: one(spark, text.locality(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), F.lit(a[3]), F.lit(a[4]), F.lit(a[5])))
    assert [near("f", 100, "f", 200, "function", False), near("f", 1, "f", 900, "function", True), near("f", 1, "f", 1, "file", False), near("f", 1, "g", 1, "function", True), near("f", 1, "g", 1, "file", False)] == [0.75, 0.0, 1.0, 0.6, 0.2]
    assert one(spark, text.locality(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit("f"), F.lit(1), F.lit("file"), F.lit(True))) == 0.2
    assert one(spark, text.eviction_score(F.lit(1.0), F.lit(0.5), F.lit("prefetch"))) == pytest.approx(0.62) and one(spark, text.eviction_score(F.lit(1.0), F.lit(0.5), F.lit("load"))) == pytest.approx(0.8)


def test_query_terms_and_differences():
    assert text.query_terms("Add the get_user flow for ab 中文") == ["get_user", "flow"]
    assert udf.line_difference("a\nb", "a\nc\nd") == "+2/-1" and udf.line_difference("a\nb", "a\nc\nd", faithful=True) == "+2/-0" and udf.line_difference("x", "x") == "+0/-0"
    assert udf.canonical_json({"b": 1, "a": ["é", None]}) == '{"a":["é",null],"b":1}'
    assert udf.capped("aé", 2, "…") == "a…" and udf.capped("aé", 3) == "aé"


def test_udfs(spark):
    df = spark.createDataFrame([("a\nb", "a\nc", '{"b":1, "a":2}'), (None, "x", None)], "o string, n string, j string")
    rows = df.select(udf.body_difference("o", "n").alias("d"), udf.canonical("j").alias("c"), udf.byte_cap(2, "!")("n").alias("b")).collect()
    assert [tuple(r) for r in rows] == [("+1/-1", '{"a":2,"b":1}', "a\n!"), (None, None, "x")]
