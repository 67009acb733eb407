"""Functions paired with their documentation, by island grammars (`functions.islands`).

Per language only comments, strings, signatures, annotations and balanced bodies are parsed, everything else is skipped
water, so files that don't parse as a whole still give their intact functions.

Defined results: null or empty bodies and unknown languages give nothing; line ends may be LF, CRLF or CR; files stored
twice give their pairs for each id; of an unclosed body everything to the end of the file belongs to it; the language
comes from the file's extension, else from `file_lang`.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.islands import functions, language_of

#: Texts that stand for documentation that was never written.
PLACEHOLDERS = {"todo", "tbd", "fixme", "xxx", "wip", "na", "n a", "none", "null", "doc", "docs", "document", "documentation", "docstring", "description", "summary", "placeholder", "undocumented", "document me", "document this", "documentation missing", "missing documentation", "no documentation", "no description", "to be done", "to be documented", "to do", "to document", "add docs", "add documentation", "add description", "add docstring", "write docs", "write me", "describe me", "fill in", "fill me in", "see above", "see below", "stub", "hack", "temp", "pending", "coming soon", "lorem ipsum", "insert description here", "description here", "autogenerated", "auto generated"}

_XML = re.compile(r"<(param|typeparam|returns|exception|value|example|remarks)\b[^>]*>.*?(?:</\1>|\Z)|<(?:param|typeparam|exception|see)\b[^>]*/>", re.S)
_TAG_LINE = re.compile(r"^\s*(?:[@\\]\w+|:(?:param|return|returns|type|rtype|raises)\b)")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields?|examples?|attributes)\s*:?\s*$", re.I)


def prose(doc: str) -> str:
    """The describing part: without markup tags, parameter tags and parameter sections."""
    if "<" in doc:
        doc = re.sub(r"</?\w[^<>]*>", " ", _XML.sub(" ", doc))
    out = []
    for x in doc.split("\n"):
        if _TAG_LINE.match(x) or _SECTION.match(x):
            break
        out.append(x.strip())
    return " ".join(" ".join(out).split())


def _split_name(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)]


def is_trivial(doc: str, name: str) -> bool:
    """No prose, a placeholder, or only the words of the function's name."""
    text = prose(doc)
    ws = re.findall(r"[^\W_]+", text.lower())
    if not any(any(c.isalpha() for c in w) for w in ws):
        return True
    if " ".join(ws) in PLACEHOLDERS or (ws[0] in ("todo", "tbd", "fixme", "xxx", "wip") and len(ws) <= 6):
        return True
    own = _split_name(name)
    split = [p for w in re.findall(r"[^\W_]+", text) for p in _split_name(w) or [w.lower()]]
    return bool(own) and set(split) <= {*own, "".join(own)}


PAIRS = "file_id long, language string, qualified_name string, name string, start_line int, end_line int, description string, documentation string, code string"


def documented_functions(source_files: DataFrame) -> DataFrame:
    """One row per function or method with non-trivial documentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "language", "qualified_name", "name", "start_line", "end_line", "description", "documentation", "code"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for i, path, named, body in zip(*(b.column(c).to_pylist() for c in ("file_id", "file_path", "file_lang", "body"))):
                language = language_of(path, named)
                rows += [(i, language, q, n, a, z, prose(doc), doc.strip(), code) for q, n, a, z, doc, code in functions(body, language) if not is_trivial(doc, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return source_files.select("file_id", "file_path", "file_lang", "body").mapInArrow(run, PAIRS)


def found(source_files: DataFrame) -> DataFrame:
    return documented_functions(source_files).select("file_id", "qualified_name", F.col("start_line"))
