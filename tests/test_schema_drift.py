import datetime
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import schema_drift as sd
from gaugeworks.sources.tables import read_table

RAW = "record_no long, log_name string, file_name string, file_time timestamp, line_no int, body string, kind string, path string"


def raw(spark, files):
    """files: (log, file, day, lines)."""
    rows, n = [], 0
    for log, name, day, lines in files:
        for k, x in enumerate(lines):
            n += 1
            rows.append((n, log, name, datetime.datetime(2030, 1, day), k, x if isinstance(x, str) or x is None else json.dumps(x), "mine", "mine"))
    return spark.createDataFrame(rows, RAW)


def report(df):
    return sorted(tuple(r)[2:] for r in sd.drift_report(sd.ingest(df)).collect())


def tool(i, **more):
    return {"tool_uid": f"t{i}", **more}


def test_added_removed_retyped_renamed(spark):
    a = [tool(i, a=i, b=f"v{i}", gone=True) for i in range(5)]
    b = [tool(i, a=float(i) + 0.5, c=f"v{i}", new=None) for i in range(5)]
    assert report(raw(spark, [("l", "z", 1, a), ("l", "a", 2, b)])) == [("added", "", "new"), ("removed", "gone", ""), ("renamed", "b", "c"), ("retyped", "a", "a")]


def test_other_lines_and_nulls(spark):
    a = [tool(1, x=1), "[]", "oops", None, "", '{"x": NaN}']
    b = [tool(1, x=None), tool(2, x={})]
    # x is there as null, so nothing is known of its kind; an empty object has no path.
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == []


def test_rename_of_a_changed_kind_and_of_nested_paths(spark):
    a = [tool(i, tool={"loc": 1000 + i}) for i in range(4)]
    b = [tool(i, metrics={"loc": f"{1000 + i:,}"}) for i in range(4)]
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == [("renamed", "tool.loc", "metrics.loc")]


def test_constant_is_no_rename(spark):
    a = [tool(i, ok=True) for i in range(6)]
    b = [tool(i, seen=True) for i in range(6)]
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == [("added", "", "seen"), ("removed", "ok", "")]


@pytest.mark.parametrize("n", [1, 2, 6])
def test_constant_under_another_name_at_any_size(spark, n):
    a = [tool(i, schema_version="2.1") for i in range(n)]
    b = [tool(i, format="2.1") for i in range(n)]
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == [("renamed", "schema_version", "format")]
    b = [tool(i, format="2.1", other="2.1") for i in range(n)]
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == [("added", "", "format"), ("added", "", "other"), ("removed", "schema_version", "")]


def test_logs_are_apart_and_ties_follow_names(spark):
    df = raw(spark, [("l", "b", 1, [tool(1, y=1)]), ("l", "a", 1, [tool(1, x=9)]), ("m", "c", 1, [tool(1, z=1)])])
    assert report(df) == [("added", "", "y"), ("removed", "x", "")]


def test_repeated_lines_and_empty_table(spark):
    a, b = [tool(1, x=1)] * 3, [tool(1)] * 2
    assert report(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)])) == [("removed", "x", "")]
    assert report(raw(spark, [])) == []
    assert report(raw(spark, [(None, "a", 1, a), ("l", None, 2, b)])) == []


def test_ingest_keeps_everything_and_promotion_replays(spark):
    a = [tool(i, tool={"loc": i, "name": "n" * (60 + i)}) for i in range(3)]
    b = [tool(i, loc=str(i), tool={"name": "n" * (60 + i)}, odd=[1, {"x": 2}]) for i in range(3)]
    rows = sd.ingest(raw(spark, [("l", "a", 1, a), ("l", "b", 2, b)]))
    got = [json.loads(r._rescued) for r in rows.where("file_name = 'b'").orderBy("line_no").collect()]
    assert got == [{"loc": str(i), "odd": [1, {"x": 2}]} for i in range(3)]
    rep = sd.drift_report(rows)
    assert ("renamed", "tool.loc", "loc") in {tuple(r)[2:] for r in rep.collect()}
    table = sd.promote(rows, sd.approved_paths(rep))
    assert sorted(r.tool__loc for r in table.collect()) == [0, 0, 1, 1, 2, 2]
    assert table.where(F.array_contains("_replayed", "loc")).count() == 3


def brute_force(lines):
    """The report by plain Python over ordered files."""
    files = defaultdict(list)
    for r in sorted(lines, key=lambda r: (r.log_name, r.file_time, r.file_name)):
        files[r.log_name, r.file_time, r.file_name].append(sd.parse_object(r.body))
    out, before = [], {}
    for (log, _t, name), objects in files.items():
        paths, values = defaultdict(set), defaultdict(lambda: defaultdict(set))
        for o in objects:
            leaves = dict(sd.leaves(o)) if o is not None else {}
            for p, v in leaves.items():
                paths[p] |= {sd.kind_of(v)} - {"null"}
                if v is not None:
                    values[p][leaves.get("tool_uid")].add(json.dumps(v).strip('"'))
        if log in before:
            old_paths, old_values = before[log]
            gone, come = set(old_paths) - set(paths), set(paths) - set(old_paths)
            for p in sorted(gone):
                for q in sorted(come):
                    both = set(old_values[p]) & set(values[q])
                    if both and sum(bool(old_values[p][t] & values[q][t]) for t in both) >= 0.8 * len(both) and len({x for t in both for x in old_values[p][t]}) > 1:
                        out.append((log, name, "renamed", p, q))
                        gone, come = gone - {p}, come - {q}
                        break
            out += [(log, name, "removed", p, "") for p in gone] + [(log, name, "added", "", q) for q in come]
            out += [(log, name, "retyped", p, p) for p in set(paths) & set(old_paths) if paths[p] and old_paths[p] and paths[p] != old_paths[p]]
        before[log] = (paths, values)
    return set(out)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_brute_force(spark, d):
    lines = read_table(spark, d, "raw_records")
    got = {tuple(r) for r in sd.drift_report(sd.ingest(lines)).collect()}
    assert got == brute_force(lines.collect())
