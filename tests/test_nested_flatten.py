import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugeworks.operators import nested_flatten as nf

TOOLS = "row_id long, tool_uid string, call_graph string, tool struct<source_location:struct<file:string,start_line:int,end_line:int>>, path string"


def brute(text):
    """Links by plain recursion."""

    def loads(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v

    out = []

    def walk(node, path):
        calls = loads(node.get("calls"))
        for k, c in enumerate([calls] if isinstance(calls, dict) else calls if isinstance(calls, list) else []):
            c = loads(c)
            if isinstance(c, dict):
                out.append((path, f"{path}.{k}"))
                walk(c, f"{path}.{k}")

    root = loads(text) if text is not None else None
    if isinstance(root, dict):
        walk(root, "0")
    return sorted(out)


def frame(spark, texts):
    return spark.createDataFrame([(i, f"u{i}", t, (("f.py", 1, 2),), "p") for i, t in enumerate(texts)], TOOLS)


def links(spark, texts):
    got = {}
    for r in nf.call_graph_links(frame(spark, texts)).collect():
        got.setdefault(r.row_id, []).append((r.parent_path, r.child_path))
    return [sorted(got.get(i, [])) for i in range(len(texts))]


node = st.recursive(st.sampled_from([None, 3, "x", {}, {"calls": None}]), lambda c: st.builds(lambda calls, extra: {"calls": calls, "level": extra}, st.one_of(st.lists(c, max_size=3), c), st.sampled_from([1, "a", None])), max_leaves=8)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(node, max_size=5))
def test_links_equal_recursion(spark, nodes):
    texts = [json.dumps(n) for n in nodes] + [json.dumps(json.dumps(n)) for n in nodes]
    assert links(spark, texts) == [brute(t) for t in texts]


def test_odd_texts(spark):
    texts = [None, "", "{", "NaN", '{"calls": [NaN]}', '{"calls": {"calls": "[{}]"}}', '{"calls": [null, {}, 5, {}]}', '{"calls": [], "calls": [{}]}', '{"qualified_name": "\\ud800", "calls": "{}"}']
    assert links(spark, texts) == [[], [], [], [], [], [("0", "0.0"), ("0.0", "0.0.0")], [("0", "0.1"), ("0", "0.3")], [("0", "0.0")], [("0", "0.0")]]


def test_depth_and_long_text(spark):
    deep = "{}"
    for _ in range(300):
        deep = '{"calls":[' + deep + "]}"
    wide = json.dumps({"calls": [{"qualified_name": "n" * 50}] * 5000})
    a, b = links(spark, [deep, wide])
    assert len(a) == 300 and len(b) == 5000


def test_repeated_rows_and_nodes(spark):
    text = json.dumps({"level": 1, "resolved": True, "source_location": json.dumps({"file": "a", "start_line": 1}), "calls": [{"level": "2", "resolved": 1}]})
    rows = nf.call_graph_nodes(frame(spark, [text]).union(frame(spark, [text]))).collect()
    assert len(rows) == 4
    root = next(r for r in rows if r.parent_path is None)
    assert (root.level, root.resolved, root.file, root.start_line, root.end_line, root.has_location) == (1, True, "a", 1, None, True)
    child = next(r for r in rows if r.parent_path == "0")
    assert (child.level, child.resolved, child.has_location, child.depth) == (None, None, False, 2)
    assert nf.location_table(frame(spark, [text])).count() == 2
    assert nf.call_graph_nodes(frame(spark, [])).count() == 0


def test_list_column(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None), (4, ["b"])], "k int, l array<string>")
    got = [tuple(r) for r in nf.flatten_list_column(df, ["k"], "l").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "a"), (1, 1, None), (4, 0, "b")], key=str)


def _deep(k):
    return '{"level":1,"calls":[' * k + "{}" + "]}" * k


TEXTS = ['{"calls":[], "calls":[{"level":1}]}','{"level":1.0,"calls":[{"level":2}]}','{"level":"x","calls":[{}]}','{"calls":[null,{"level":3},null,{}]}','{"calls":[1,"a",{"level":2},[{}],true]}','{"level":NaN,"calls":[{}]}','{"level":99999999999999999999,"calls":[{}]}',
'{"qualified_name":"2020-01-01","calls":[{"qualified_name":"a\\u0000b"}]}','{"qualified_name":"\\ud800","calls":[{}]}','{"calls":{"level":1}}','{"calls":"[{\\"level\\":4}]"}','"{\\"calls\\":[{}]}"','{"calls":[{}]} {"calls":[{}]}','{"calls":[{}]}}','[]','{}','',None,'null','{"calls":[{"source_location":null},{"source_location":{"file":"a","start_line":1}},{"source_location":"{\\"file\\":\\"b\\"}"},{"source_location":[1]}]}',
'{"calls":[{"x":{"calls":[{}]}}]}','{"calls":[{"qualified_name":"{\\"calls\\": {"}]}','{"calls":\n[\n{"level":\t1}]}\n','{"calls":[{"qualified_name":"a\nb"}]}','{"a":1,}','{"calls":[{}],"resolved":true,"external":"yes"}',_deep(3),_deep(20),_deep(40),_deep(300),_deep(3000),"{'calls':[]}",'{"level":-0,"calls":[{"level":1e2}]}','{"calls":[{"level":1}, ["x", {"calls":[{}]}]]}','﻿{"calls":[{}]}','{"calls":[{}]}\x00','{"calls":null}','{"level":true,"calls":[{}]}','{"resolved":1,"calls":[{}]}','{"qualified_name":5,"calls":[{}]}', '{"calls":[{}],"b":/*c*/1}','{"calls":[{"level":01}]}','{"calls":["{\\"level\\":7}"]}']


def test_block_reader_equals_one_by_one():
    """Over regular, irregular and broken texts, together and each alone, both ways give the same rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row_id": pa.array(range(len(TEXTS)), pa.int64()), "tool_uid": pa.array([str(i) for i in range(len(TEXTS))]), "call_graph": pa.array(TEXTS, pa.string())})
    rows = lambda parts: sorted(repr(r) for p in parts for r in p.to_pylist())
    want = rows(nf._walk(batch))
    assert rows(nf._flatten([batch])) == want and len(want) > 300
    assert sorted(r for i in range(len(TEXTS)) for r in rows(nf._flatten([batch.slice(i, 1)]))) == want
    assert nf._regular(batch.column("call_graph")).sum() > 20
