"""Definitions, calls, imports and tools of source files; call graphs as relations.

Files are parsed one by one with the island grammars (a table function per file, so a repository's files never meet in one
task); everything across files is relational: calls are resolved by ordered candidate joins, graphs are bounded self-joins
over resolved edges, closures of tools walks over one repository's call names at a time; closures of any graph are a
semi-naive loop whose frontier is checkpointed each round.

Fidelity: other than with full grammars, calls inside string interpolation are not seen, and complexity counts decision
keywords outside strings and comments. A file stored twice in a repository counts once (the smallest id). Null bodies and
unknown languages give nothing.
"""

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import Source, _close, close_bracket, functions, language_of
from ..session import ensure_checkpoint_dir

#: Words that open a decision, by language; else, default and boolean operators never count.
DECISIONS = {
    "python": r"\b(?:if|elif|for|while|except|case)\b",
    "typescript": r"\b(?:if|for|while|case|catch)\b|\?(?![.?:])",
    "java": r"\b(?:if|for|while|case|catch)\b|\?(?![>,.:])",
    "csharp": r"\b(?:if|for|foreach|while|case|catch)\b",
    "go": r"\b(?:if|for|case)\b",
    "rust": r"\b(?:if|for|while|loop)\b|=>",
    "ruby": r"\b(?:if|elsif|unless|while|until|for|when|rescue)\b",
}
DECISIONS["javascript"] = DECISIONS["typescript"]
DECISIONS["kotlin"] = r"\b(?:if|for|while|catch)\b|->"
DECISIONS["dart"] = DECISIONS["java"]
_DECIDE = {k: re.compile(v) for k, v in DECISIONS.items()}
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::|->|&\.)\s*)?([A-Za-z_$][\w$]*[!?]?)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "match", "catch", "return", "def", "func", "fn", "function", "elif", "with", "and", "or", "not", "in", "is", "lambda", "yield", "await", "new", "super", "typeof", "sizeof", "foreach", "using", "lock", "except", "print", "assert", "del", "raise", "unless", "until", "when", "while", "loop", "async", "class", "import", "else", "do", "try", "throw", "case"}
_SELF = {"self", "this", "cls", "Self", "super"}
_IMPORTS = {
    "python": [re.compile(r"^[ \t]*from\s+([\w.]+)\s+import\s+\(?([\w ,\n]+)\)?", re.M), re.compile(r"^[ \t]*import\s+([\w.]+)(?:\s+as\s+(\w+))?", re.M)],
    "typescript": [re.compile(r"\bimport\s+(?:type\s+)?\{([^}]*)\}\s*from\s*[\"']([^\"']+)[\"']"), re.compile(r"\bimport\s+(?:\*\s+as\s+)?(\w+)\s+from\s*[\"']([^\"']+)[\"']")],
}


def _complexity(code: str, language: str) -> int:
    return 1 + len(_DECIDE[language].findall(code))


# What several extractors need of a file is found once: they run on it one after the other.


@lru_cache(maxsize=1)
def _parsed(text: str, language: str) -> tuple[Source, tuple[tuple, ...]]:
    """The islands of a file and its functions."""
    s = Source(text, language)
    return s, tuple(functions(text, language, s))


@lru_cache(maxsize=1)
def _tools_of(text: str, language: str) -> tuple[tuple, ...]:
    return tuple(_tools(text, language))


def _bodies(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, name, first line, last line) of every function, and of every registering call whose handler stands inside it."""
    out = [(q, n, a, z) for q, n, a, z, _d, _c in _parsed(text, language)[1]]
    inline = {(q, a, z) for _n, _d, _l, _p, q, a, z in _tools_of(text, language) if q.startswith("<call:")}
    return sorted(out + [(q, q, a, z) for q, a, z in inline], key=lambda f: (f[2], -f[3]))


def _owner(qualified: str) -> str | None:
    return qualified.rsplit(".", 1)[0] if "." in qualified and not qualified.startswith("<") else None


def _definitions(text: str, language: str) -> Iterator[tuple]:
    code = _parsed(text, language)[0].code.split("\n")
    found = _bodies(text, language)
    for i, (qualified, name, a, z) in enumerate(found):
        lines = code[a - 1 : z]
        # A function nested in this one is a boundary: its lines are not this one's decisions.
        for _q, _n, b, y in found[i + 1 :]:
            if b > z:
                break
            if a < b and y <= z:
                lines[b - a : y - a + 1] = [""] * (y - b + 1)
        yield qualified, name, _owner(qualified), a, z, _complexity("\n".join(lines), language)


def _calls(text: str, language: str) -> Iterator[tuple]:
    lines = _parsed(text, language)[0].code.split("\n")
    for qualified, name, a, z in _bodies(text, language):
        code = "\n".join(lines[a - 1 : z])
        seen: dict[str, tuple] = {}
        # The definition's own header names the function once; it is no call. Nor is the registering call itself.
        head = True
        for m in _CALL.finditer(code):
            receiver, callee = m.group(1), m.group(2)
            if head and (callee == name and receiver is None or qualified.startswith("<call:")):
                head = False
                continue
            if callee in _KEYWORDS or receiver in _KEYWORDS:
                continue
            raw = (f"{receiver}." if receiver else "") + callee
            seen.setdefault(raw, (qualified, a, len(seen), receiver, callee, raw))
        yield from seen.values()


def _links(text: str, language: str) -> Iterator[tuple]:
    """(kind, qualified name, name, class, callers): what a closure needs of a file. Of calls: the callee, the class it is sought in (null if called without a receiver) and who calls it."""
    for qualified, name, _a, _z in _bodies(text, language):
        yield "definition", qualified, name, None, None
    callers: dict[tuple, dict] = {}
    for caller, _line, _ord, receiver, callee, _raw in _calls(text, language):
        owner = receiver if receiver not in _SELF else caller.split(".", 1)[0] if "." in caller else ""
        if owner != "":  # a call of its own class outside of one has no target
            callers.setdefault((owner, callee), {})[caller] = None
    for (owner, callee), who in callers.items():
        yield "call", None, callee, owner, list(who)
    for qualified in dict.fromkeys(f[4] for f in _tools_of(text, language)):
        yield "tool", qualified, None, None, None


def _imports(text: str, language: str) -> Iterator[tuple]:
    kind = "typescript" if language in ("typescript", "javascript") else language
    if kind not in _IMPORTS:
        return
    first, second = _IMPORTS[kind]
    if kind == "python":
        code = Source(text, language).code
        for m in first.finditer(code):
            for part in m.group(2).split(","):
                names = part.split()
                if names:
                    yield names[-1], m.group(1), names[0]
        for m in second.finditer(code):
            yield m.group(2) or m.group(1).split(".")[0], m.group(1), m.group(1)
    else:
        for m in first.finditer(text):
            for part in m.group(1).split(","):
                names = part.split()
                if names:
                    yield names[-1], m.group(2), names[0]
        for m in second.finditer(text):
            yield m.group(1), m.group(2), m.group(1)


#: One literal, closed by the quote that opened it; and a run of them that are joined, as the group.
_ONE = r"""[rR]?(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
_STR = rf"({_ONE}(?:\s*\+?\s*{_ONE})*)"
_LITERAL = re.compile(_ONE, re.S)
_ESCAPE = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|(.))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\n": ""}


def _value(literals: str, language: str) -> str:
    """The text of one or several joined literals."""
    out = []
    for m in _LITERAL.finditer(literals):
        q = m.group()
        raw, q = q[0] in "rR" or (language == "go" and q[0] == "`"), q.lstrip("rR")
        n = 3 if q[:3] in ('"""', "'''") and len(q) >= 6 else 1
        body = q[n:-n]
        out.append(body if raw else _ESCAPE.sub(lambda e: chr(int(e.group(1) or e.group(2), 16)) if e.group(3) is None else _ESCAPED.get(e.group(3), e.group(3)), body))
    return "".join(out)


def _shallow(plain: str, code: str, at: int, end: int, depth: int) -> str:
    """The text from the bracket at `at` to `end`, without what is nested deeper than `depth` brackets."""
    out, level, last = [], 0, at
    for m in re.compile(r"[()\[\]{}]").finditer(code, at, end):
        if m.group() in "([{":
            level += 1
            if level == depth + 1:
                out.append(plain[last : m.start()])
        else:
            level -= 1
            if level == depth:
                last = m.end()
    if level <= depth:
        out.append(plain[last:end])
    return "".join(out)


#: Values bound at the top level of a file, by language: the name and where its expression begins.
_BINDING = {
    "python": re.compile(r"^(\w+)[ \t]*(?::[^=\n]+)?=(?!=)", re.M),
    "typescript": re.compile(r"^(?:export[ \t]+)?(?:const|let|var)[ \t]+([\w$]+)[ \t]*(?::[^=\n]+)?=(?![=>])", re.M),
    "go": re.compile(r"^(?:const|var)[ \t]+(\w+)(?:[ \t]+\w+)?[ \t]*=(?!=)", re.M),
    "rust": re.compile(r"^(?:pub[ \t]+)?(?:const|static)[ \t]+(\w+)[ \t]*:[^=\n]+=(?!=)", re.M),
    "java": re.compile(r"\bstatic[ \t]+final[ \t]+[\w<>\[\]]+[ \t]+(\w+)[ \t]*=(?!=)"),
}
_BINDING["javascript"] = _BINDING["typescript"]
_NAME_ONLY = re.compile(r"[A-Za-z_$][\w$]*")
#: How often a name that stands for a name is followed.
HOPS = 4


def _bindings(s: Source, plain: str, language: str) -> dict[str, tuple[int, int]]:
    """Name -> (begin, end) of the expression bound to it at the top level; the last binding counts."""
    out = {}
    for m in _BINDING[language].finditer(s.code) if language in _BINDING else ():
        at, depth, end = m.end(), 0, len(s.code)
        for k in re.compile(r"[()\[\]{};\n]").finditer(s.code, at):
            c = k.group()
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif depth <= 0 and (c == ";" or plain[at : k.start()].strip() and not re.match(r"\s*[+.\"'`]", plain[k.end() :])):
                end = k.start()
                break
        out[m.group(1)] = (at, end)
    return out


def _values(text: str, language: str) -> Iterator[tuple]:
    """(name, literal text or null, name it stands for or null, line) of every value bound at the top level."""
    s = Source(text, language)
    plain = _comments_blanked(s)
    for name, (a, z) in _bindings(s, plain, language).items():
        expression = plain[a:z].strip().rstrip(";").strip()
        literal = re.fullmatch(_STR, expression, re.S)
        yield name, _value(expression, language) if literal else None, expression if _NAME_ONLY.fullmatch(expression) else None, s.line(a)


def _in_file(name: str, bound: dict[str, tuple[int, int]], plain: str, language: str) -> str | None:
    """The literal a name stands for in its own file, following at most HOPS names."""
    for _ in range(HOPS):
        if name not in bound:
            return None
        expression = plain[slice(*bound[name])].strip().rstrip(";").strip()
        if re.fullmatch(_STR, expression, re.S):
            return _value(expression, language)
        if not _NAME_ONLY.fullmatch(expression):
            return None
        name = expression
    return None


def _spans(first: int, last: int, s: Source, bound: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """The given span and those of the values that it names, followed at most HOPS times: where a handler's tools may stand."""
    spans, seen, new = [(first, last)], set(), [(first, last)]
    for _ in range(HOPS):
        names = {m.group() for a, z in new for m in _NAME_ONLY.finditer(s.code, a, z)} & bound.keys() - seen
        seen |= names
        new = [bound[n] for n in sorted(names) if not first <= bound[n][0] < last]
        spans += new
        if not new:
            break
    return spans


#: Triggers of a tool: pattern over the text whose comments are blanked; group `name` where the call or annotation names it.
_TRIGGER = {
    "python": re.compile(r"@\s*\w+\.tool\b(?:\s*(\())?"),
    "java": re.compile(r"@Tool\b(?:\s*(\())?"),
    "csharp": re.compile(r"(\[)\s*McpServerTool\b"),
    "rust": re.compile(r"#(\[)\s*tool\b"),
}
_NAMED = re.compile(r"\bname\s*[=:]\s*" + _STR, re.I | re.S)
_NAMED_BY = re.compile(r"\bname\s*[=:]\s*([A-Za-z_$][\w$]*)\s*(?=[,)}]|$)", re.I)
_DESCRIBED = re.compile(r"\bdescription\s*[=:]\s*(?:" + _STR + r"(?=\s*(?:[,)\]};]|$))|([^,)\]}]+))", re.I | re.S)
_REGISTER = re.compile(r"\b\w+\.(?:tool|registerTool|AddTool)\s*\(\s*(?:\w+\s*,\s*&\w+(?:\.\w+)?\s*\{[^}]*?Name\s*:\s*)?" + _STR, re.S)
#: Tools listed by a low-level handler: the handler, and each entry with its literal name.
_LIST_HANDLER = {"python": re.compile(r"@\s*\w+\.list_tools\s*\("), "typescript": re.compile(r"\bsetRequestHandler\s*\((?=\s*(?:ListToolsRequestSchema|[\"']tools/list[\"']))")}
_LISTED = {"python": re.compile(r"\bTool\s*\(\s*name\s*=\s*(?:" + _STR + r"|([A-Za-z_]\w*))"), "typescript": re.compile(r"\{\s*name\s*:\s*(?:" + _STR + r"|([A-Za-z_$][\w$]*)\s*(?=[,}]))")}
#: Registration with named arguments: Dart's registerTool(Tool(name: ...)) and Kotlin's addTool(name = ...).
_NAMED_REGISTER = {"dart": re.compile(r"\bregisterTool\s*\(\s*(?:const\s+)?Tool\s*\("), "kotlin": re.compile(r"\baddTool\s*\(")}
#: Third-party registration: server.addTool({name: ..., execute: ...}) and a bare addTool({...}); without a handler it is no tool.
_ADD_TOOL = re.compile(r"(?<![\w$])addTool\s*\(\s*\{")
_RUBY_TOOL = re.compile(r"^[ \t]*class\s+(\w+)\s*<\s*(?:\w+::)*\w*Tool\b", re.M)


def _comments_blanked(s: Source) -> str:
    out = list(s.text)
    for a, b, _k in s.notes:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "
    return "".join(out)


def _handler(name: str | None, s: Source, found: tuple[tuple, ...], begin: int, end: int) -> tuple[str, int, int]:
    """(qualified name, first and last line) of a tool's handler: the function of that name in the file, else the call that holds it."""
    own = next((f for f in found if name and name in (f[0], f[1])), None)
    return (own[0], own[2], own[3]) if own else (name or f"<call:{s.line(begin)}>", s.line(begin), s.line(end - 1))


def _tools(text: str, language: str) -> Iterator[tuple]:
    """(name, description, literal, pattern, qualified name, line, end line); a tool whose name is no literal is skipped."""
    s, found = _parsed(text, language)
    plain = _comments_blanked(s)
    bound = _bindings(s, plain, language)

    def described(d: re.Match | None) -> tuple[str, bool]:
        """(description, whether it is a literal); a name bound to a literal in this file stands for that text, but is no literal."""
        if not d:
            return "", True
        if d.group(1) is not None:
            return _value(d.group(1), language), True
        raw = d.group(2).strip()
        return (_in_file(raw, bound, plain, language) if _NAME_ONLY.fullmatch(raw) else None) or raw, False

    def named(args: str) -> str | None:
        """The name an argument list gives, literally or by a name bound to a literal."""
        n = _NAMED.search(args)
        if n:
            return _value(n.group(1), language)
        n = _NAMED_BY.search(args)
        return _in_file(n.group(1), bound, plain, language) if n else None

    decorated: set[tuple] = set()
    if language in _TRIGGER:
        for m in _TRIGGER[language].finditer(plain):
            line = s.line(m.start())
            nearest = min((f for f in found if f[2] >= line), key=lambda f: f[2], default=None)
            opened = m.start(1) if m.group(1) else None
            end = m.end() if opened is None else _close(s.code, opened, "()" if m.group(1) == "(" else "[]")
            if nearest is None or nearest[2] - s.line(end) > 6:
                continue
            qualified, own, a, z, doc, _code = nearest
            if (qualified, a) in decorated:  # the first of several decorators counts
                continue
            decorated.add((qualified, a))
            args = "" if opened is None else _shallow(plain, s.code, opened, end, 2 if language == "rust" else 1)
            if language == "csharp":
                between = plain[m.start() : s.ends[a - 1] if a - 1 < len(s.ends) else None]
                d = re.search(r"\bDescription\s*\(\s*" + _STR, between, re.S)
                yield own, _value(d.group(1), language) if d else "", True, "csharp.server_tool_attribute", qualified, a, z
                continue
            n = named(args)
            if re.search(r"\bname\s*=", args) and n is None and language != "python":
                continue
            d = _DESCRIBED.search(args)
            description, literal = described(d) if d else (doc.strip() if language in ("python", "rust") else "", True)
            yield n if n is not None else own, description, literal, {"python": "python.fastmcp_decorator", "java": "java.tool_annotation", "rust": "rust.tool_attribute"}[language], qualified, a, z
    listing = "typescript" if language == "javascript" else language
    for m in _LIST_HANDLER[listing].finditer(plain) if listing in _LIST_HANDLER else ():
        line = s.line(m.start())
        handler = min((f for f in found if f[2] > line), key=lambda f: f[2], default=None)
        if listing == "python" and (handler is None or handler[2] - line > 6):
            continue
        a, z = (handler[2], handler[3]) if listing == "python" else (line, s.line(close_bracket(s.code, m.end() - 1)))
        first, last = (s.ends[a - 2] + 1 if a > 1 else 0), (s.ends[z - 1] if z - 1 < len(s.ends) else len(plain))
        listed: set[str] = set()
        for begin, end in _spans(first, last, s, bound):
            for e in _LISTED[listing].finditer(plain, begin, end):
                name = _value(e.group(1), language) if e.group(1) is not None else _in_file(e.group(2), bound, plain, language)
                if name is None or name in listed:  # the branches of a choice may list a tool twice
                    continue
                listed.add(name)
                at = plain.index("(" if listing == "python" else "{", e.start())
                d = _DESCRIBED.search(_shallow(plain, s.code, at, _close(s.code, at, "()" if listing == "python" else "{}"), 1))
                yield name, *described(d), "python.list_tools_lowlevel" if listing == "python" else f"{language}.set_request_handler_lowlevel", handler[0] if listing == "python" else f"<call:{line}>", a, z
    for m in _NAMED_REGISTER[language].finditer(plain) if language in _NAMED_REGISTER else ():
        args = plain[m.end() : close_bracket(s.code, m.end() - 1)]
        n, d = _NAMED.search(args), _DESCRIBED.search(args)
        if n:
            line = s.line(m.start())
            yield _value(n.group(1), language), *described(d), f"{language}.{'register_tool' if language == 'dart' else 'add_tool'}", f"<call:{line}>", line, s.line(close_bracket(s.code, m.end() - 1))
    for m in _ADD_TOOL.finditer(plain) if listing == "typescript" else ():
        opened = plain.index("(", m.start())
        end = close_bracket(s.code, opened)
        args = _shallow(plain, s.code, opened, end, 2)
        n, d = named(args), _DESCRIBED.search(args)
        if n is not None and re.search(r"\bexecute\b", args):
            handler = re.search(r"\bexecute\s*:\s*([A-Za-z_$][\w$]*)\s*[,}]", args)
            yield n, *described(d), f"{language}.add_tool", *_handler(handler.group(1) if handler else None, s, found, m.start(), end)
    if language in ("typescript", "javascript", "go"):
        for m in _REGISTER.finditer(plain):
            line = s.line(m.start())
            opened = plain.index("(", m.start())
            end = close_bracket(s.code, opened)
            d = re.compile(r"\s*,\s*" + _STR + r"(?=\s*[,)])", re.S).match(plain, m.end(), end) or _DESCRIBED.search(_shallow(plain, s.code, opened, end, 2)[m.end() - opened :])
            last = re.compile(r",\s*(?:\w+\.)?([A-Za-z_$][\w$]*)\s*,?\s*\)$").search(plain[opened:end])
            yield _value(m.group(1), language), *described(d), f"{language}.register_tool" if language != "go" else "go.add_tool", *_handler(last.group(1) if last else None, s, found, m.start(), end)
    elif language == "ruby":
        classes = list(_RUBY_TOOL.finditer(plain))
        for m, after in zip(classes, [*(k.start() for k in classes[1:]), len(plain)]):
            call = next((f for f in found if f[0] == f"{m.group(1)}.call"), None)
            if call:
                n, d = (re.compile(rf"\b{k}\s+" + _STR, re.S).search(plain, m.end(), after) for k in ("tool_name", "description"))
                yield _value(n.group(1), language) if n else m.group(1), _value(d.group(1), language) if d else "", True, "ruby.tool_class", call[0], call[2], call[3]


def _first_ids(source_files: DataFrame) -> DataFrame:
    return source_files.groupBy("repo_name", "file_path").agg(F.min("file_id").alias("file_id")).select("file_id")


def unique_files(source_files: DataFrame) -> DataFrame:
    """Each path of a repository once: the file with the smallest id."""
    return source_files.join(_first_ids(source_files), "file_id", "left_semi")


#: Rows that an extractor hands on at once; a file's (a root's) rows stay together. Ids of repeated files that are broadcast at most. Roots of a repository that one task walks from.
CHUNK, FEW, ROOTS = 20_000, 100_000, 2_000


def _per_file(source_files: DataFrame, extract: Callable[[str, str], Iterator[tuple]], columns: list[tuple[str, str]]) -> DataFrame:
    """One row per extracted item: file_id, repo_name, file_path, seq and the item's columns."""
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "repo_name", "file_path", "seq", *(n for n, _ in columns)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), *(types[t] for _, t in columns)]
        for b in batches:
            rows: list[tuple] = []
            chunk = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)  # noqa: B023, E731
            for i, repo, path, lang, body in zip(*(b.column(c).to_pylist() for c in ("file_id", "repo_name", "file_path", "file_lang", "body"))):
                language = language_of(path, lang)
                if body and language:
                    rows += [(i, repo, path, k, *item) for k, item in enumerate(extract(body, language))]
                if len(rows) >= CHUNK:
                    yield chunk()
                    rows = []
            yield chunk()

    schema = "file_id long, repo_name string, file_path string, seq int, " + ", ".join(f"{n} {t}" for n, t in columns)
    return source_files.select("file_id", "repo_name", "file_path", "file_lang", "body").mapInArrow(run, schema)


def definitions(source_files: DataFrame) -> DataFrame:
    return _per_file(source_files, _definitions, [("qualified_name", "string"), ("bare_name", "string"), ("class_name", "string"), ("start_line", "int"), ("end_line", "int"), ("complexity", "int")])


def call_sites(source_files: DataFrame) -> DataFrame:
    """Calls of each function, once per raw text in a body."""
    return _per_file(source_files, _calls, [("caller", "string"), ("caller_line", "int"), ("ord", "int"), ("receiver", "string"), ("callee", "string"), ("raw_text", "string")])


def imports(source_files: DataFrame) -> DataFrame:
    return _per_file(source_files, _imports, [("alias", "string"), ("module", "string"), ("original_name", "string")])


def values(source_files: DataFrame) -> DataFrame:
    """Values bound at the top level of files, with their literal text or the name they stand for."""
    return _per_file(source_files, _values, [("bare_name", "string"), ("literal", "string"), ("stands_for", "string"), ("line", "int")])


def resolve_values(refs: DataFrame, table: DataFrame, imported: DataFrame) -> DataFrame:
    """refs (repo_name, file_id, file_path, name) with literal, target_file, step and ambiguous, following at most HOPS names.

    A name is sought 1 in its own file, 2 where it was imported from (files named as the module or as the name), 3 in the
    repository; of several candidates of a step the nearest by directory is taken and the name is ambiguous. Values are
    reduced to the shallowest per name and ancestor directory, so names and values are never all paired.
    """
    key = ["repo_name", "file_path", "name"]
    at = F.struct("file_id", "seq")
    v = table.groupBy("repo_name", "file_path", F.col("bare_name").alias("name")).agg(F.max_by("literal", at).alias("literal"), F.max_by("stands_for", at).alias("stands_for"))
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")

    def nearest(rows: DataFrame, more: list[str]) -> DataFrame:
        """Shallowest values per name and ancestor directory (and the columns of `more`)."""
        under = rows.select("repo_name", "name", *more, F.col("file_path").alias("target_file"), _depth(F.col("file_path")).alias("deep"), F.explode(_directories(F.col("file_path"))).alias("a"))
        one = under.groupBy("repo_name", "name", *more, F.col("a.prefix").alias("prefix"), "deep").agg(F.count(F.lit(1)).alias("n"), F.min("target_file").alias("target_file"))
        return one.groupBy("repo_name", "name", *more, "prefix").agg(F.min(F.struct("deep", "n", "target_file")).alias("b")).select("repo_name", "name", *more, "prefix", "b.*")

    def step(names: DataFrame, found: DataFrame, on: list[str], out: str) -> DataFrame:
        met = names.select(*key, *[c for c in on if c not in key], _depth(F.col("file_path")).alias("own"), F.explode(_directories(F.col("file_path"))).alias("a")).select(*key, *[c for c in on if c not in key], "own", F.col("a.prefix").alias("prefix"), F.col("a.depth").alias("depth")).join(found, [*on, "prefix"])
        return met.groupBy(*key).agg(F.min_by("target_file", F.struct(F.col("own") + F.col("deep") - 2 * F.col("depth"), F.col("target_file"))).alias(out))

    names = refs.select(*key).distinct()
    modules = imported.select("repo_name", "file_path", F.col("alias").alias("name"), F.regexp_replace("module", r"^[./]*", "").alias("m")).select("repo_name", "file_path", "name", F.explode(F.array_distinct(F.array(F.regexp_replace(F.regexp_extract("m", r"([^./]*(?:\.(?:js|ts|mjs))?)$", 1), r"\.(js|ts|mjs)$", ""), F.col("name")))).alias("stem")).distinct()
    tagged = v.withColumn("stem", stem(F.col("file_path")))
    of_module = names.join(modules, key)
    total = v.groupBy("repo_name", "name").agg(F.count(F.lit(1)).alias("n_all"))
    n_module = of_module.join(tagged.select("repo_name", "name", "stem", F.col("file_path").alias("t")), ["repo_name", "name", "stem"]).groupBy(*key).agg(F.countDistinct("t").alias("n_module"))
    second = step(of_module, nearest(tagged, ["stem"]), ["repo_name", "name", "stem"], "second")
    third = step(names, nearest(v, []), ["repo_name", "name"], "third")
    own = v.select(*key, F.lit(True).alias("here"))
    out = names.join(own, key, "left").join(second, key, "left").join(n_module, key, "left").join(third, key, "left").join(total, ["repo_name", "name"], "left")
    which = F.when(F.col("here"), 1).when(F.col("second").isNotNull(), 2).when(F.col("third").isNotNull(), 3).otherwise(0)
    target = F.when(F.col("here"), F.col("file_path")).otherwise(F.coalesce("second", "third"))
    several = F.when(F.col("step") == 2, F.col("n_module") > 1).when(F.col("step") == 3, F.col("n_all") > 1).otherwise(False)
    return out.select(*key, which.alias("step"), target.alias("target_file"), "n_module", "n_all").select(*key, "step", "target_file", several.alias("ambiguous")).join(
        v.select("repo_name", F.col("file_path").alias("target_file"), "name", "literal", "stands_for"), ["repo_name", "target_file", "name"], "left"
    )


def followed_values(refs: DataFrame, table: DataFrame, imported: DataFrame) -> DataFrame:
    """repo_name, file_path, name, literal, hops: names followed through names, across files, until a literal (null where there is none within HOPS).

    The values and imports are read once and each hop's few open names are checkpointed, so plans stay short.
    """
    ensure_checkpoint_dir(refs.sparkSession)
    table, imported = table.checkpoint(), imported.checkpoint()
    start = refs.select("repo_name", "file_path", "name").distinct()
    at = start.withColumn("at_file", F.col("file_path")).withColumn("at_name", F.col("name"))
    done = None
    for hop in range(1, HOPS + 1):
        got = resolve_values(at.select("repo_name", F.col("at_file").alias("file_path"), F.col("at_name").alias("name")), table, imported).select("repo_name", F.col("file_path").alias("at_file"), F.col("name").alias("at_name"), "target_file", "literal", "stands_for")
        step = at.join(got, ["repo_name", "at_file", "at_name"]).checkpoint()
        end = step.where("stands_for is null" if hop < HOPS else "true").select("repo_name", "file_path", "name", "literal", F.lit(hop).alias("hops"))
        done = end if done is None else done.unionByName(end)
        at = step.where("stands_for is not null").select("repo_name", "file_path", "name", F.col("target_file").alias("at_file"), F.col("stands_for").alias("at_name"))
        if at.isEmpty():
            break
    return done


def described_tools(tools: DataFrame, table: DataFrame, imported: DataFrame) -> DataFrame:
    """Tools whose description is a name of another file get the text that name stands for there; it stays no literal."""
    refs = tools.where(~F.col("description_is_literal") & F.col("description").rlike(r"^[A-Za-z_$][\w$]*$")).select("repo_name", "file_path", F.col("description").alias("name"))
    found = followed_values(refs, table, imported).where("literal is not null").select("repo_name", "file_path", F.col("name").alias("description"), F.col("literal").alias("__gw_text"), F.lit(False).alias("description_is_literal"))
    return tools.join(found, ["repo_name", "file_path", "description", "description_is_literal"], "left").withColumn("description", F.coalesce("__gw_text", "description")).select(*tools.columns)


def detected_tools(source_files: DataFrame) -> DataFrame:
    return _per_file(source_files, _tools, [("name", "string"), ("description", "string"), ("description_is_literal", "boolean"), ("sdk_pattern", "string"), ("qualified_name", "string"), ("start_line", "int"), ("end_line", "int")])


def definition_index(defs: DataFrame) -> DataFrame:
    """One definition per repository and qualified name: the last by file and place."""
    at = F.struct("file_id", "seq")
    return defs.groupBy("repo_name", "qualified_name").agg(*(F.max_by(c, at).alias(c) for c in ("file_path", "bare_name", "class_name", "start_line", "end_line", "complexity")))


def _directories(path: Column) -> Column:
    """The directory of a path and all its ancestors, from the root (depth 0) down, as (prefix, depth)."""
    parts = F.split(path, "/")
    own = F.greatest(F.size(parts) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), own), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))


def _depth(path: Column) -> Column:
    return F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))


def resolve_calls(calls: DataFrame, defs: DataFrame, imported: DataFrame) -> DataFrame:
    """Each call with its resolution by the first step of a cascade that has a candidate.

    Steps: 1 a member of the caller's own class (self or this), 2 a function of the same file, 3 a member of the class
    named as receiver, or an imported name, 4 the repository (calls without a receiver only). Steps 3 (imports) and 4 take
    the candidate nearest by directory; several in equal distance make the call ambiguous, none makes it external.

    The nearest is found without pairing calls and definitions: definitions are reduced to the shallowest per name and
    ancestor directory, and a call looks up its own few ancestors. The tree distance through an ancestor at depth p is
    own depth + candidate depth - 2 p, and it is exact at the deepest common one, where it is smallest.
    """
    key = ["repo_name", "file_id", "caller", "caller_line", "ord"]
    d = definition_index(defs).withColumnRenamed("qualified_name", "target")
    c = calls.withColumn("own_class", F.when(F.instr("caller", ".") > 0, F.substring_index("caller", ".", 1)))
    is_self = F.coalesce(F.col("receiver").isin(*_SELF), F.lit(False))
    c = c.withColumn("member_of", F.when(is_self, F.col("own_class")).otherwise(F.col("receiver"))).withColumn("is_self", is_self)
    members = d.where("class_name is not null").select("repo_name", F.col("class_name").alias("member_of"), F.col("bare_name").alias("callee"), F.col("target").alias("member"))
    local = d.where("class_name is null").groupBy("repo_name", F.col("file_path"), F.col("bare_name").alias("callee")).agg(F.min("target").alias("local"))
    mine = imported.select("file_id", F.col("alias").alias("callee"), F.lit(True).alias("imported")).distinct()
    c = c.join(members, ["repo_name", "member_of", "callee"], "left").join(local, ["repo_name", "file_path", "callee"], "left").join(mine, ["file_id", "callee"], "left")
    # Shallowest definitions per repository, name and ancestor directory.
    under = d.select("repo_name", F.col("bare_name").alias("callee"), "target", _depth(F.col("file_path")).alias("deep"), F.explode(_directories(F.col("file_path"))).alias("a")).groupBy("repo_name", "callee", F.col("a.prefix").alias("prefix"), "deep").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("near"))
    under = under.groupBy("repo_name", "callee", "prefix").agg(F.min(F.struct("deep", "n", "near")).alias("b")).select("repo_name", "callee", "prefix", "b.*")
    open_calls = c.where("receiver is null and member is null and local is null").select(*key, "callee", _depth(F.col("file_path")).alias("own"), F.explode(_directories(F.col("file_path"))).alias("a"))
    met = open_calls.select(*key, "callee", "own", "a.prefix", "a.depth").join(under, ["repo_name", "callee", "prefix"]).withColumn("dist", F.col("own") + F.col("deep") - 2 * F.col("depth"))
    best = met.groupBy(*key).agg(F.min(F.struct("dist", "near")).alias("b"), F.min("dist").alias("dist"), F.collect_list(F.struct("dist", "n")).alias("all"))
    nearest = best.select(*key, F.col("b.near").alias("nearest"), (F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["dist"] == F.col("dist"), x["n"]).otherwise(0)) > 1).alias("several"))
    out = c.join(nearest, key, "left")
    free = F.col("receiver").isNull()
    step = (
        F.when(F.col("is_self") & F.col("member").isNotNull(), 1).when(free & F.col("local").isNotNull(), 2).when(F.col("member").isNotNull(), 3).when(free & F.col("nearest").isNotNull() & F.coalesce("imported", F.lit(False)), 3).when(free & F.col("nearest").isNotNull(), 4).otherwise(0)
    )
    target = F.when(F.col("step") == 2, F.col("local")).when((F.col("step") > 0) & F.col("member").isNotNull(), F.col("member")).when(F.col("step") > 0, F.col("nearest"))
    out = out.withColumn("step", step).withColumn("target", target)
    return out.select(*calls.columns, "target", "step", F.col("target").isNotNull().alias("resolved"), ((F.col("step") >= 3) & F.col("member").isNull() & F.coalesce("several", F.lit(False))).alias("ambiguous"), F.col("target").isNull().alias("external"))


def edges_of(resolved: DataFrame) -> DataFrame:
    """repo_name, source, target: distinct unambiguous resolved calls."""
    return resolved.where("resolved and not ambiguous").select("repo_name", F.col("caller").alias("source"), "target").distinct()


def bounded_call_graph(resolved: DataFrame, roots: DataFrame, levels: int = 3) -> DataFrame:
    """repo_name, root, path, level, name, external: call tree of each root down to `levels` (the root is level 1)."""
    base = roots.select("repo_name", F.col("qualified_name").alias("root")).distinct().withColumn("path", F.lit("0")).withColumn("level", F.lit(1)).withColumn("name", F.col("root")).withColumn("external", F.lit(False))
    calls = resolved.select("repo_name", F.col("caller").alias("name"), "ord", F.coalesce("target", "raw_text").alias("callee"), "external").dropDuplicates(["repo_name", "name", "ord"])
    out, at = base, base
    for k in range(2, levels + 1):
        at = at.where("not external").select("repo_name", "root", "path", "name").join(calls, ["repo_name", "name"]).select("repo_name", "root", F.concat_ws(".", "path", F.col("ord").cast("string")).alias("path"), F.lit(k).alias("level"), F.col("callee").alias("name"), "external")
        out = out.unionByName(at)
    return out


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """repo_name, root, name: everything reachable from each root, itself included.

    Semi-naive: a round joins only the last round's new pairs to the edges and takes away what is known. Each round's new
    pairs are checkpointed once and what is known is their union, so lineage stays short, nothing known is written again
    and a lost executor costs one round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("repo_name", "source", "target").distinct().checkpoint()
    known = roots.select("repo_name", F.col("qualified_name").alias("root")).distinct().withColumn("name", F.col("root")).checkpoint()
    new = known
    for _ in range(max_rounds):
        step = new.join(e, (new["repo_name"] == e["repo_name"]) & (new["name"] == e["source"])).select(new["repo_name"], "root", F.col("target").alias("name")).distinct()
        new = step.join(known, ["repo_name", "root", "name"], "left_anti").checkpoint()
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError("closure did not end")


def tool_closure(source_files: DataFrame) -> DataFrame:
    """repo_name, root, name: everything reachable from each tool, over the unambiguous resolved calls of unique files.

    The same as closure() of resolve_calls() and detected_tools() of unique_files(), for tables whose texts are too large
    to move: a file is read and parsed once, and only the names found leave the task that read it. They stay persisted
    until the calls are resolved.
    """
    ensure_checkpoint_dir(source_files.sparkSession)
    repeated = source_files.select("file_id").join(_first_ids(source_files), "file_id", "left_anti").checkpoint()
    if repeated.count() <= FEW:
        repeated = F.broadcast(repeated)
    columns = [("kind", "string"), ("qualified_name", "string"), ("bare_name", "string"), ("class_name", "string"), ("callers", "array<string>")]
    links = _per_file(source_files.where("file_id is not null"), _links, columns).join(repeated, "file_id", "left_anti").persist()
    kept = [links]
    try:
        links.count()  # else each of its readers would parse the files
        calls = _linked(links, kept).groupBy("repo_name", "source").agg(F.collect_set("target").alias("targets")).checkpoint()
        return closure_by_repository(calls, links.where("kind = 'tool'").select("repo_name", "qualified_name").distinct().checkpoint())
    finally:
        for k in kept:
            k.unpersist()


def closure_by_repository(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """repo_name, root, name: as of closure(), from calls (repo_name, source, targets) with one row per source.

    Pairs may be many times the edges (all pairs of a repository's functions, where calls go round), so none is shuffled or
    stored: each task gets the calls of whole repositories, as names only, with at most about ROOTS of their roots, walks
    from each root and hands the pairs on. A task holds one repository's calls at a time.
    """
    parts = roots.groupBy("repo_name").agg(F.ceil(F.count(F.lit(1)) / ROOTS).cast("int").alias("parts"))
    begin = roots.join(parts, "repo_name", "left").select("repo_name", F.pmod(F.xxhash64("qualified_name"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("qualified_name").alias("name"), F.lit(None).cast("array<string>").alias("targets"))
    edges = calls.join(parts, "repo_name").select("repo_name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("source").alias("name"), "targets")
    # The number is given, else few bytes of calls would end in one task, however many their pairs.
    n = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.unionByName(begin).repartition(n, "repo_name", "part").sortWithinPartitions("repo_name", "part", F.col("targets").isNull())
    return rows.mapInArrow(_walk, "repo_name string, root string, name string")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of root and reached name, of rows sorted by repository and part, calls before roots (which have no targets)."""
    at, ids, after, names, out, n = None, {}, {}, None, [], 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([o[k] for o in out]) for k in range(3)], names=["repo_name", "root", "name"])

    for b in batches:
        for repo, part, name, targets in zip(*(b.column(c).to_pylist() for c in ("repo_name", "part", "name", "targets"))):
            if at != (repo, part):
                at, ids, after, names = (repo, part), {}, {}, None
            if targets is not None:
                after[ids.setdefault(name, len(ids))] = [ids.setdefault(x, len(ids)) for x in targets]
                continue
            if names is None:
                names = pa.array(list(ids), pa.string())
            if name in ids:
                seen = new = {ids[name]}
                while new:
                    new = set().union(*(after.get(x, ()) for x in new)) - seen
                    seen = seen | new
                reached = names.take(pa.array(list(seen), pa.int64()))
            else:
                reached = pa.array([name], pa.string())
            out.append((pa.repeat(pa.scalar(repo, pa.string()), len(reached)), pa.repeat(pa.scalar(name, pa.string()), len(reached)), reached))
            n += len(reached)
            if n >= CHUNK:
                yield chunk()
                out, n = [], 0
    if out:
        yield chunk()


def _linked(links: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """repo_name, source, target as of edges_of(resolve_calls()). kept: gets what is persisted.

    Calls of a file to one callee go as one row. A call can only be resolved to a definition of its repository with its
    bare name, so calls without one, and definitions that nobody calls, are dropped first. A member's qualified name is
    its class and name, a function's its name, so those are looked up as they are; the nearest definition depends on a
    call's directory only and is sought once per directory and name. Imports tell the step, never the target.
    """
    name = ["repo_name", "bare_name"]
    calls, defs = links.where("kind = 'call'"), links.where("kind = 'definition'")
    d = defs.repartition(*name).groupBy(*name, "qualified_name").agg(F.max_by("file_path", F.struct("file_id", "seq")).alias("at")).join(calls.select(*name).distinct(), name, "left_semi").persist()
    kept.append(d)
    d.count()
    path = F.col("file_path")
    place = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))  # a path without its last part
    c = calls.select(*name, "class_name", "file_path", place.alias("place"), "callers").join(d.select(*name).distinct(), name, "left_semi").persist()
    kept.append(c)
    c.count()
    members = c.where("class_name is not null").withColumn("target", F.concat_ws(".", "class_name", "bare_name")).join(d.select("repo_name", F.col("qualified_name").alias("target")), ["repo_name", "target"], "left_semi")
    free = c.where("class_name is null").join(d.where("qualified_name = bare_name").select(*name, F.col("at").alias("own_file")), name, "left").withColumn("local", F.coalesce(F.col("own_file") == path, F.lit(False)))
    near = _nearest(free.where("not local").select(*name, "place").distinct(), d)
    outer = free.where("not local").join(near, [*name, "place"])
    found = [members.select("repo_name", "callers", "target"), free.where("local").select("repo_name", "callers", F.col("bare_name").alias("target")), outer.select("repo_name", "callers", F.col("near").alias("target"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("repo_name", F.explode("callers").alias("source"), "target")


def _nearest(sought: DataFrame, d: DataFrame) -> DataFrame:
    """repo_name, bare_name, place, near: the definition that is nearest by directory, where no other is as near; as in resolve_calls()."""
    name = ["repo_name", "bare_name"]
    under = d.select(*name, "qualified_name", _depth(F.col("at")).alias("deep"), F.explode(_directories(F.col("at"))).alias("a")).groupBy(*name, F.col("a.prefix").alias("prefix"), "deep").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("near"))
    under = under.groupBy(*name, "prefix").agg(F.min(F.struct("deep", "n", "near")).alias("b")).select(*name, "prefix", "b.*")
    met = sought.select(*name, "place", _depth(F.col("place")).alias("own"), F.explode(_directories(F.col("place"))).alias("a")).select(*name, "place", "own", "a.prefix", "a.depth").join(under, [*name, "prefix"])
    # Of a candidate's ancestors only the deepest common one is at its distance, so those at the least distance are counted once each.
    by_distance = met.groupBy(*name, "place", (F.col("own") + F.col("deep") - 2 * F.col("depth")).alias("dist")).agg(F.sum("n").alias("n"), F.min("near").alias("near"))
    return by_distance.groupBy(*name, "place").agg(F.min(F.struct("dist", "n", "near")).alias("b")).where("b.n = 1").select(*name, "place", "b.near")


def tool_measures(tools: DataFrame, reach: DataFrame, defs: DataFrame) -> DataFrame:
    """repo_name, qualified_name, loc, complexity: sums over everything a tool reaches."""
    index = definition_index(defs).select("repo_name", F.col("qualified_name").alias("name"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "complexity")
    own = tools.select("repo_name", F.col("qualified_name").alias("root")).distinct()
    rows = reach.join(own, ["repo_name", "root"], "left_semi").join(index, ["repo_name", "name"])
    return rows.groupBy("repo_name", F.col("root").alias("qualified_name")).agg(F.sum("lines").alias("loc"), F.sum("complexity").alias("complexity"), F.count(F.lit(1)).alias("functions"))


def render_source_view(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, view: the snippets of a tool's located call nodes in pre-order, each with a header.

    A node's path sorts its snippets (positions padded), so the text is put together from one sorted list per tool.
    """
    from ..functions.keys import line_slice

    text = files.groupBy("file_path", "repo_name").agg(F.min_by("body", "file_id").alias("body"))
    own = nodes.where("has_location").withColumn("repo_name", F.substring_index("tool_uid", "::", 1))
    rows = own.join(text, (own["file"] == text["file_path"]) & (own["repo_name"] == text["repo_name"]))
    order = F.transform(F.split("node_path", r"\."), lambda p: F.lpad(p, 8, "0"))
    chunk = F.concat(F.lit("# "), F.coalesce("qualified_name", F.lit("?")), F.lit(" ("), F.col("file"), F.lit(")\n"), F.coalesce(line_slice(F.col("body"), F.col("start_line").cast("int"), F.col("end_line").cast("int")), F.lit("")))
    return rows.select("row_id", F.struct(F.array_join(order, ".").alias("o"), chunk.alias("c")).alias("s")).groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["c"]), "\n\n").alias("view"))
