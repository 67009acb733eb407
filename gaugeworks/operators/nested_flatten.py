"""Deeply nested records to related flat tables, with Arrow list offsets and parent-index kernels.

The call graph of a tool arrives as JSON text. The texts of a slice of rows go through Arrow's block JSON reader, which
builds nested Arrow columns from the whole block; no row is parsed on its own. A level of the tree is then a list column:
`list_parent_indices` gives each child's parent, `list_flatten` the children, positions follow from the parents' counts,
and the keys (row id, tool id, parent path) by `take`. The schema of the reader names the fields of LEVELS
levels and whether there is another; rows that go deeper are set apart. `flatten_list_column` does the same for list columns
that are already Arrow arrays (nested Parquet).

Rows that the block reader cannot take are set apart by vectorised tests (unbalanced brackets, JSON text in a string, an
object in place of an array), by their depth or, where it refuses a block, by halving it; only these are decoded one by
one, and their levels again go through list offsets and `take`.

Defined results: null or invalid JSON, and JSON that is no object, gives no nodes; null elements of `calls` are no nodes
but take a position; a single object in place of an array is the child at position 0; JSON text held in a JSON string
counts as what it holds; a field of an unexpected type becomes null; of a repeated JSON key the last counts; JSON nested
deeper than Python's decoder goes (some thousand levels) counts as invalid; an empty table gives empty tables. Rows are
independent, so a repeated row id gives its links as often as the row occurs.
"""

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes decoded at a time, which bounds a Python worker's memory whatever Spark's batch size is.
SLICE_BYTES = 4 << 20

NODE_SCHEMA = (
    "row_id long, tool_uid string, node_path string, parent_path string, position int, depth int, level long, resolved boolean, external boolean, "
    "ambiguous boolean, qualified_name string, raw_call_text string, file string, start_line long, end_line long, has_location boolean"
)


def _no_constant(name: str):
    raise ValueError(name)


def _decode(text):
    """The value of JSON text, strictly; None where it is not valid."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError, TypeError):
        return None


def _unwrap(v):
    """JSON text in a string counts as the JSON it holds."""
    while isinstance(v, str):
        v = _decode(v)
    return v


def _children(node: dict) -> list:
    calls = _unwrap(node.get("calls"))
    if isinstance(calls, dict):
        return [calls]
    return calls if isinstance(calls, list) else []


def _clean(s: str) -> str:
    """Arrow strings are UTF-8, which has no lone surrogates."""
    return s.encode("utf-8", "replace").decode("utf-8") if not s.isascii() else s


def _strings(values: list) -> pa.Array:
    return pa.array([_clean(v) if isinstance(v, str) else None for v in values], pa.string())


def _longs(values: list) -> pa.Array:
    return pa.array([v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def _booleans(values: list) -> pa.Array:
    return pa.array([v if isinstance(v, bool) else None for v in values], pa.bool_())


def _level(nodes: list, row_id: pa.Array, tool_uid: pa.Array, path: pa.Array, parent: pa.Array, position: pa.Array, depth: int) -> pa.RecordBatch:
    get = lambda k: [n.get(k) for n in nodes]
    places = [p if isinstance(p, dict) else None for p in map(_unwrap, get("source_location"))]
    at = lambda k: [p.get(k) if p else None for p in places]
    columns = {
        "row_id": row_id, "tool_uid": tool_uid, "node_path": path, "parent_path": parent, "position": position, "depth": pa.array(np.full(len(nodes), depth, np.int32)),
        "level": _longs(get("level")), "resolved": _booleans(get("resolved")), "external": _booleans(get("external")), "ambiguous": _booleans(get("ambiguous")),
        "qualified_name": _strings(get("qualified_name")), "raw_call_text": _strings(get("raw_call_text")),
        "file": _strings(at("file")), "start_line": _longs(at("start_line")), "end_line": _longs(at("end_line")), "has_location": pa.array([p is not None for p in places], pa.bool_()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The levels of rows decoded one by one."""
    roots = [_unwrap(t) for t in batch.column("call_graph").to_pylist()]
    keep = pa.array([i for i, r in enumerate(roots) if isinstance(r, dict)], pa.int64())
    nodes = [roots[i] for i in keep.to_pylist()]
    row_id, tool_uid = batch.column("row_id").take(keep), batch.column("tool_uid").take(keep)
    path = pa.array(["0"] * len(nodes), pa.string())
    parent, position, depth = pa.nulls(len(nodes), pa.string()), pa.array(np.zeros(len(nodes), np.int32)), 1
    while nodes:
        yield _level(nodes, row_id, tool_uid, path, parent, position, depth)
        lists = [_children(n) for n in nodes]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), out=offsets[1:])
        flat = [_unwrap(c) for own in lists for c in own]
        # The list column of this level: its values are the places of the children.
        calls = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.arange(len(flat), dtype=np.int32)))
        parents = pc.list_parent_indices(calls)
        places = pc.subtract(pc.list_flatten(calls), pa.array(offsets[:-1]).take(parents))
        real = pa.array([isinstance(c, dict) for c in flat], pa.bool_())
        parents, position = parents.filter(real), places.filter(real).cast(pa.int32())
        nodes = [c for c in flat if isinstance(c, dict)]
        parent = path.take(parents)
        path = pc.binary_join_element_wise(parent, position.cast(pa.string()), ".")
        row_id, tool_uid, depth = row_id.take(parents), tool_uid.take(parents), depth + 1


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of `column`."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


#: Levels of nodes the block reader's schema names; rows with more are decoded one by one.
LEVELS = 16

_LEAVES = [("level", pa.int64()), ("resolved", pa.bool_()), ("external", pa.bool_()), ("ambiguous", pa.bool_()), ("qualified_name", pa.string()), ("raw_call_text", pa.string())]
_PLACE = [("file", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64())]


def _node_fields() -> list[pa.Field]:
    fields = [*_LEAVES, ("source_location", pa.struct(_PLACE))]
    node = pa.struct([("level", pa.int64())])  # the level below the last named one: only whether it is there
    for _ in range(LEVELS):
        node = pa.struct([*fields, ("calls", pa.list_(node))])
    return list(node)


_SCHEMA = pa.schema(_node_fields())


def _read_block(texts: pa.Array) -> pa.StructArray | None:
    """The nodes of one JSON object a row, or None where the reader refuses or does not find exactly one in each."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py().encode()
    try:
        table = pj.read_json(
            io.BytesIO(data),
            read_options=pj.ReadOptions(use_threads=False, block_size=len(data) + 1),
            parse_options=pj.ParseOptions(explicit_schema=_SCHEMA, newlines_in_values=True, unexpected_field_behavior="ignore"),
        )
    except pa.ArrowInvalid:
        return None
    return table.to_struct_array().combine_chunks() if table.num_rows == len(texts) else None


def _levels(nodes: pa.StructArray, row_id: pa.Array, tool_uid: pa.Array) -> tuple[list[tuple[pa.RecordBatch, np.ndarray]], np.ndarray]:
    """(the flat table of each level with the row of the block each node is of, the rows that go deeper than LEVELS)."""
    n, out = len(nodes), []
    path = pa.array(["0"] * n, pa.string())
    parent, position, row = pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32))
    for depth in range(1, LEVELS + 1):
        if not len(nodes):
            break
        get = lambda k: pc.struct_field(nodes, k)  # noqa: B023, E731
        place = get("source_location")
        columns = {"row_id": row_id, "tool_uid": tool_uid, "node_path": path, "parent_path": parent, "position": position, "depth": pa.array(np.full(len(nodes), depth, np.int32))}
        columns |= {k: get(k) for k, _ in _LEAVES} | {k: pc.struct_field(place, k) for k, _ in _PLACE} | {"has_location": place.is_valid()}
        out.append((pa.RecordBatch.from_pydict(columns), row.to_numpy()))
        calls = get("calls")
        parents, children = pc.list_parent_indices(calls), pc.list_flatten(calls)
        owner = parents.to_numpy(zero_copy_only=False)
        count = np.bincount(owner, minlength=len(nodes)) if len(owner) else np.zeros(len(nodes), np.int64)
        places = np.arange(len(owner)) - (np.cumsum(count) - count)[owner] if len(owner) else np.zeros(0, np.int64)
        real = children.is_valid()
        parents, nodes = parents.filter(real), children.filter(real)
        position = pa.array(places.astype(np.int32)).filter(real)
        parent = path.take(parents)
        path = pc.binary_join_element_wise(parent, position.cast(pa.string()), ".")
        row_id, tool_uid, row = row_id.take(parents), tool_uid.take(parents), row.take(parents)
    return out, np.unique(row.to_numpy()) if len(nodes) else np.zeros(0, np.int32)


def _walk_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The levels of a block of regular rows; a block that is refused is halved, single and deep rows are decoded on their own."""
    nodes = _read_block(batch.column("call_graph"))
    if nodes is not None:
        out, deep = _levels(nodes, batch.column("row_id"), batch.column("tool_uid"))
        for level, row in out:
            yield level.filter(pa.array(~np.isin(row, deep))) if len(deep) else level
        if len(deep):
            yield from _walk(batch.take(pa.array(deep)))
    elif batch.num_rows == 1:
        yield from _walk(batch)
    else:
        half = batch.num_rows // 2
        yield from _walk_block(batch.slice(0, half))
        yield from _walk_block(batch.slice(half))


def _regular(texts: pa.Array) -> np.ndarray:
    """Rows that look like one JSON object whose calls are arrays of objects; what is really there the reader decides."""
    count = lambda c: pc.fill_null(pc.count_substring(texts, c), 0).to_numpy(zero_copy_only=False)
    match = lambda r: pc.fill_null(pc.match_substring_regex(texts, r), False).to_numpy(zero_copy_only=False)
    whole = match(r"(?s)^\s*\{.*\}\s*$") & (count("{") == count("}")) & (count("[") == count("]"))
    return whole & ~match(r'"(?:calls|source_location)"\s*:\s*"|"calls"\s*:\s*\{|"calls"\s*:\s*\[(?:[^\[\]{}]*,)?\s*"')


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "call_graph"):
            regular = _regular(part.column("call_graph"))
            if regular.any():
                yield from _walk_block(part.filter(pa.array(regular)))
            if not regular.all():
                yield from _walk(part.filter(pa.array(~regular)))


def call_graph_nodes(tools: DataFrame) -> DataFrame:
    """The flat table of nodes of all rows of `tools`: one row per node, with the path of its parent (null at the root)."""
    return tools.select("row_id", "tool_uid", "call_graph").mapInArrow(_flatten, NODE_SCHEMA)


def call_graph_links(tools: DataFrame) -> DataFrame:
    """row_id, parent_path, child_path of every link."""
    nodes = call_graph_nodes(tools)
    return nodes.where(F.col("parent_path").isNotNull()).select("row_id", "parent_path", F.col("node_path").alias("child_path"))


def location_table(tools: DataFrame) -> DataFrame:
    """The flat table of locations of tools (owner_kind 'tool', path null) and of nodes (owner_kind 'node')."""
    place = F.col("tool.source_location")
    own = tools.where(place.isNotNull()).select(
        "row_id", "tool_uid", F.lit("tool").alias("owner_kind"), F.lit(None).cast("string").alias("node_path"),
        place["file"].alias("file"), place["start_line"].cast("long").alias("start_line"), place["end_line"].cast("long").alias("end_line"),
    )
    nodes = call_graph_nodes(tools).where("has_location").select("row_id", "tool_uid", F.lit("node").alias("owner_kind"), "node_path", "file", "start_line", "end_line")
    return own.unionByName(nodes)


def flatten_list_column(df: DataFrame, keys: list[str], column: str, child: str = "value") -> DataFrame:
    """Child table of a list column of plain values: the keys, position (from 0) and the value.

    Works on the Arrow buffers alone: offsets, parent indices and take. Null and empty lists have no children; null
    elements stay children with a null value.
    """
    value_type = df.schema[column].dataType.elementType
    schema = df.select(*keys).schema.add("position", T.IntegerType()).add(child, value_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(column)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            parents, values = pc.list_parent_indices(lists), pc.list_flatten(lists)
            counts = np.bincount(parents.to_numpy(zero_copy_only=False), minlength=b.num_rows) if len(parents) else np.zeros(b.num_rows, np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            position = np.arange(len(values)) - (starts[parents.to_numpy(zero_copy_only=False)] if len(parents) else 0)
            out = {k: b.column(k).take(parents) for k in keys} | {"position": pa.array(position.astype(np.int32)), child: values}
            yield pa.RecordBatch.from_pydict(out)

    return df.select(*keys, column).mapInArrow(run, schema)
