from pyspark.sql import functions as F

from tidewater.operators import shapes


def test_kinds(spark):
    rows = [("x", "a/B.Md", "markdown"), ("x", "a.tsv", "csv"), ("x", "Makefile", "prose"), (' [1]', None, "json"), ("a\n## b", "", "markdown"), ("a ## b", None, "prose"), ("#b", "x.unknown", "prose"), (None, None, "prose")]
    got = spark.createDataFrame(rows, "t string, p string, k string").select("k", shapes.kind_of(F.col("t"), F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [r.k for r in got]


def test_json_reports(spark):
    texts = {
        1: '{"b": 1.0, "a": [1, {"x": "]}"}], "e": {}}', 2: "[]", 3: "[[], 2]", 4: '"s"', 5: "{broken", 6: "{" + ", ".join(f'"k{i:02}": {i}' for i in range(15)) + "}", 7: "123456789012345678901234567890", 8: None, 9: "", 10: "[1e5, true]",
        12: "[1] [2]", 11: '{"text": "' + "y" * 300 + '"}',
    }
    got = {r.k: r for r in shapes.json_reports(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t").collect()}
    assert got[1].shape == "object, 3 top-level key(s) [b: float, a: array, e: object], max depth 3" and len(got[1].samples) == 3
    assert got[2].shape == "array of 0 item(s) (element type: empty), max depth 0" and got[3].shape == "array of 2 item(s) (element type: array), max depth 1"
    assert got[4].shape == "scalar (str)" and got[7].shape == "scalar (int)" and got[10].shape.startswith("array of 2 item(s) (element type: float)")
    assert got[6].shape.endswith("k11: int, …(+3 more)], max depth 1") and set(got) == {1, 2, 3, 4, 6, 7, 10, 11}
    assert got[11].samples == ['"' + "y" * 199 + "…"]


def test_json_sketch(spark):
    rows = [('{"a": [1, {"b": null}]}',), ('{"a": 2}',), ("[]",), ("no",), (None,)]
    got = shapes.json_sketch(spark.createDataFrame(rows, "t string"), "t").collect()
    assert {(r.path, r.type): r.n for r in got} == {("$", "object"): 2, ("$", "array"): 1, ("$.a", "array"): 1, ("$.a", "int"): 1, ("$.a[]", "int"): 1, ("$.a[]", "object"): 1, ("$.a[].b", "null"): 1}
    assert next(r.example for r in got if r.path == "$.a" and r.type == "int") == "2"
    assert shapes.json_sketch(spark.createDataFrame([], "t string"), "t").count() == 0


def test_csv(spark):
    text = 'id,"na""me, x",v\r\n1,"a, b",2.5\r\n2,,x\r\n\r\n3\r\n'
    got = sorted(shapes.csv_columns(spark.createDataFrame([("f", text), ("g", ""), ("h", "only,head")], "k string, t string"), "k", "t").collect(), key=lambda r: (r.k, r.column))
    assert [(r.k, r.column, r.name, r.n, r.filled, r.type, r.least, r.most) for r in got] == [
        ("f", 1, "id", 3, 3, "int", "1.0", "3.0"), ("f", 2, 'na"me, x', 2, 1, "str", "a, b", "a, b"), ("f", 3, "v", 2, 2, "str", "2.5", "x"),
        ("h", 1, "only", 0, 0, None, None, None), ("h", 2, "head", 0, 0, None, None, None),
    ]


def test_logs(spark):
    text = "\n".join(["start", "tick", "tick", "tick", "", "", "", "Traceback (most recent call last):", "x", "y", "z", "it failed"])
    r = shapes.log_reports(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("k").collect()
    assert tuple(r[0]) == (1, 12, 9, 1, 2, "it failed", 7) and tuple(r[1]) == (2, 1, 1, 0, 0, None, 0)


def test_headings(spark):
    text = "Intro one. Intro two! Three.\n# A  \nfirst\nline. second? third.\n####### not\n### B\n\n#c"
    got = sorted(shapes.heading_gists(spark.createDataFrame([(1, text), (2, "")], "k int, t string"), "k", "t").collect(), key=lambda r: r.at)
    assert [(r.at, r.level, r.heading, r.gist) for r in got] == [(0, None, None, "Intro one. Intro two!"), (2, 1, "A", "first line. second?"), (6, 3, "B", "#c")]
