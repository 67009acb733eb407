"""Queries of the extraction operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as x
from ..operators import nested_flatten
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _files(s, d):
    return x.unique_files(read_table(s, d, "source_files"))


def _resolved(s, d):
    f = _files(s, d)
    return x.resolve_calls(x.call_sites(f), x.definitions(f), x.imports(f))


def _reach(s, d):
    f = _files(s, d)
    return x.tool_closure(read_table(s, d, "source_files")), x.definitions(f), f


QUERIES["ext03_definitions"] = lambda s, d: x.definitions(_files(s, d))
QUERIES["ext09_call_sites"] = lambda s, d: x.call_sites(_files(s, d))
QUERIES["ext09_imports"] = lambda s, d: x.imports(_files(s, d))
QUERIES["ext10_detected_tools"] = lambda s, d: x.detected_tools(_files(s, d))
QUERIES["ext04_values"] = lambda s, d: x.values(_files(s, d))
QUERIES["ext11_described_tools"] = lambda s, d: (lambda f: x.described_tools(x.detected_tools(f), x.values(f), x.imports(f)))(_files(s, d))
QUERIES["jn21_resolved_values"] = lambda s, d: (lambda v, f: x.followed_values(v.where("stands_for is not null").select("repo_name", "file_path", F.col("stands_for").alias("name")), v, x.imports(f)))(x.values(_files(s, d)), _files(s, d))
QUERIES["jn20_resolved_calls"] = _resolved
QUERIES["jn22_tools_with_definition"] = lambda s, d: x.detected_tools(_files(s, d)).select("repo_name", "name", "qualified_name").join(x.definition_index(x.definitions(_files(s, d))), ["repo_name", "qualified_name"])
QUERIES["ext05_call_graph"] = lambda s, d: x.bounded_call_graph(_resolved(s, d), x.detected_tools(_files(s, d)))
QUERIES["ext06_call_graph_depth"] = lambda s, d: x.bounded_call_graph(_resolved(s, d), x.detected_tools(_files(s, d))).groupBy("repo_name", "root").agg(F.max("level").alias("profundidade"))
QUERIES["ext07_closure"] = lambda s, d: _reach(s, d)[0]
QUERIES["ext25_source_view"] = lambda s, d: x.render_source_view(nested_flatten.call_graph_nodes(read_table(s, d, "tools")), read_table(s, d, "source_files"))


def _measures(s, d):
    reach, defs, f = _reach(s, d)
    return x.tool_measures(x.detected_tools(f), reach, defs)


QUERIES["ext08_tool_measures"] = _measures


def _supplier_closure(s, d):
    """Closure over a graph with cycles: edges by arithmetic on supplier keys."""
    t = read_table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    n = t.select(F.count(F.lit(1)).alias("n")).scalar()
    e = t.select(F.explode(F.array_compact(F.array(F.struct("k", ((F.col("k") * 7 + 3) % n).alias("t")), F.when(F.col("k") % 5 == 0, F.struct("k", ((F.col("k") * 3 + 1) % n).alias("t")))))).alias("e"))
    edges = e.select(F.lit("r").alias("repo_name"), F.col("e.k").alias("source"), F.col("e.t").alias("target"))
    return x.closure(edges, t.select(F.lit("r").alias("repo_name"), F.col("k").alias("qualified_name"))).select("root", "name")


QUERIES["ext07_supplier_closure"] = _supplier_closure
ORACLE["ext07_supplier_closure"] = """
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), k AS (SELECT s_suppkey::BIGINT AS k FROM supplier),
    e AS (SELECT k AS a, (k * 7 + 3) % n AS b FROM k, n UNION SELECT k, (k * 3 + 1) % n FROM k, n WHERE k % 5 = 0),
    c AS (SELECT k AS root, k AS name FROM k UNION SELECT c.root, e.b FROM c JOIN e ON c.name = e.a)
    SELECT root, name FROM c"""
