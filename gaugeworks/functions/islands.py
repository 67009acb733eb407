"""Island grammars: comments, strings, signatures and balanced bodies of ten languages, everything else skipped.

Only the islands are parsed: comments and string literals (one token pattern per language), class-like and function
signatures, annotations, and balanced bodies. Everything else is water, so files that don't parse as a whole still give
their intact functions. Islands inside comments or strings are water too, because those are blanked before signatures are
sought.
"""

import bisect
import re
from collections.abc import Iterator

#: File extensions and language names.
EXTENSIONS = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "rs": "rust", "cs": "csharp", "go": "go", "rb": "ruby", "dart": "dart", "kt": "kotlin", "kts": "kotlin"}
NAMES = {"python": "python", "typescript": "typescript", "javascript": "javascript", "java": "java", "rust": "rust", "c#": "csharp", "csharp": "csharp", "go": "go", "golang": "go", "ruby": "ruby", "dart": "dart", "kotlin": "kotlin"}

_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_CLASSIC = rf"(?P<line>//[^\n]*)|(?P<block>{_BLOCK})"
_TOKENS = {
    "python": r"(?P<line>#[^\n]*)|(?P<str>[bBrRuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _DQ + "|" + _SQ + "))",
    "typescript": _CLASSIC + rf"|(?P<str>{_DQ}|{_SQ}|`(?:\\.|[^`\\])*(?:`|\Z)|(?<=[(,=:\[!&|?] )/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/|(?<=[(,=:\[!&|?])/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)",
    "java": _CLASSIC + r'|(?P<str>"""(?:\\.|[^\\])*?(?:"""|\Z)|' + rf"{_DQ}|{_SQ})",
    "csharp": _CLASSIC + r'|(?P<pre>^[ \t]*#[^\n]*)|(?P<str>"""+.*?(?:"""+|\Z)|[@$]{1,2}"(?:""|\\.|[^"\\])*(?:"|\Z)|' + rf"{_DQ}|'(?:\\.|[^'\\\n])+')",
    "rust": _CLASSIC + r'|(?P<str>b?r(?P<h>#+)".*?(?:"(?P=h)|\Z)|b?r"[^"]*(?:"|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|b?' + r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')",
    "go": _CLASSIC + rf"|(?P<str>{_DQ}|`[^`]*(?:`|\Z)|'(?:\\.[^'\n]{{0,9}}|[^'\\\n])')",
    "ruby": rf"(?P<block>^=begin\b.*?(?:^=end\b[^\n]*|\Z))|(?P<line>#[^\n]*)|(?P<str><<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=tag)\b|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|%[qQwWiI]?\([^)]*(?:\)|\Z))",
}
_TOKENS["kotlin"] = _TOKENS["java"]
_TOKENS["dart"] = _CLASSIC + r"|(?P<str>r?(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _DQ + "|" + _SQ + "))"
_TOKENS["javascript"] = _TOKENS["typescript"]
_TOKEN = {k: re.compile(v, re.S | re.M) for k, v in _TOKENS.items()}
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: [^\n]*)?$", re.M)


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


class Source:
    """A text with its islands: `code` is the text with comments and strings blanked, `notes` the comments in order."""

    def __init__(self, text: str, language: str):
        self.text = _MARKER.sub(lambda m: " " * len(m.group()), text.replace("\r\n", "\n").replace("\r", "\n"))
        self.notes: list[tuple[int, int, str]] = []
        self.strings: dict[int, int] = {}
        parts, at = [], 0
        for m in _TOKEN[language].finditer(self.text):
            kind = next(k for k in ("line", "block", "str", "pre") if m.groupdict().get(k) is not None)
            if kind in ("line", "block"):
                self.notes.append((m.start(), m.end(), kind))
            elif kind == "str":
                self.strings[m.start()] = m.end()
            parts += [self.text[at : m.start()], _blank(m.group())]
            at = m.end()
        self.code = "".join([*parts, self.text[at:]])
        self.ends = [m.start() for m in re.finditer("\n", self.text)]
        self._note_starts = [n[0] for n in self.notes]

    def notes_above(self, begin: int, low: int) -> Iterator[tuple[int, int, str]]:
        """The comments that end at `begin` or before it and begin at `low` or behind it, the nearest first."""
        for k in range(bisect.bisect_left(self._note_starts, begin) - 1, -1, -1):
            n = self.notes[k]
            if n[0] < low:
                return
            if n[1] <= begin:
                yield n

    def line(self, place: int) -> int:
        """The line of a place, from 1."""
        return bisect.bisect_left(self.ends, place) + 1


def _close(code: str, at: int, pair: str) -> int:
    """The place behind the bracket that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(code)


def close_bracket(code: str, at: int) -> int:
    """The place behind the round bracket that closes the one at `at`."""
    return _close(code, at, "()")


# ---- Python and Ruby: scopes by indentation ----

_PY = re.compile(r"^([ \t]*)(?:(class)|(?:async[ \t]+)?def)[ \t]+(\w+)", re.M)
_RB = re.compile(r"^([ \t]*)(?:(class|module)[ \t]+(?:\w+::)*([A-Z]\w*)|(?:(?:private|public|protected|module_function|private_class_method|memoize)[ \t]+)*def[ \t]+(?:self\.|[A-Z]\w*\.)?([A-Za-z_]\w*[?!=]?|[-+*/%<>=!~^&|\[\]]+))", re.M)


def _width(indent: str) -> int:
    return len(indent.expandtabs(8))


def _python(s: Source) -> Iterator[tuple[str, str, int, int, str]]:
    scopes: list[tuple[int, str, str]] = []
    for m in _PY.finditer(s.code):
        indent, is_class, name = _width(m.group(1)), m.group(2), m.group(3)
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        owner = scopes[-1] if scopes else None
        scopes.append((indent, "class" if is_class else "def", name))
        if is_class:
            continue
        at = m.end()
        opening = re.compile(r"\s*(?:\[[^\n]*?\])?\s*\(").match(s.code, at)
        if not opening:
            continue
        end = _close(s.code, opening.end() - 1, "()")
        colon = re.compile(r"[^:\n]*(?:\[[^\]]*\][^:\n]*)*:").match(s.code, end)
        if not colon:
            continue
        doc = _docstring(s, colon.end())
        yield (f"{owner[2]}.{name}" if owner and owner[1] == "class" else name), name, m.start(3), _block_end(s, m.start(), indent, colon.end()), doc


def _docstring(s: Source, at: int) -> str:
    """The string literal that is the first statement behind `at`, or ''."""
    n = len(s.text)
    while at < n:
        if s.text[at] in " \t\n\\":
            at += 1
        elif s.text[at] == "#":
            at = s.text.find("\n", at)
            if at < 0:
                return ""
        else:
            break
    end = s.strings.get(at)
    if end is None:
        return ""
    m = re.match(r"[rRuU]?(\"\"\"|'''|\"|')(.*)", s.text[at:end], re.S)
    if not m:
        return ""
    rest = s.code[end:].split("\n", 1)[0].strip()
    if rest and rest[0] not in ";":
        return ""
    quote, body = m.groups()
    return body[: -len(quote)] if body.endswith(quote) else body


def _block_end(s: Source, start: int, indent: int, at: int) -> int:
    """The end of an indented block: before the first later line of code that is indented no further."""
    for m in re.compile(r"^([ \t]*)(?=\S)", re.M).finditer(s.code, at):
        if m.start() > at and _width(m.group(1)) <= indent:
            return len(s.code[: m.start()].rstrip())
    return len(s.text.rstrip())


def _ruby(s: Source) -> Iterator[tuple[str, str, int, int, str]]:
    scopes: list[tuple[int, str, str]] = []
    for m in _RB.finditer(s.code):
        indent = _width(m.group(1))
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        if m.group(2):
            scopes.append((indent, "class", m.group(3)))
            continue
        owner, name = (scopes[-1] if scopes else None), m.group(4)
        scopes.append((indent, "def", name))
        end = re.compile(rf"^[ \t]{{0,{indent}}}end\b", re.M).search(s.code, m.end())
        yield (f"{owner[2]}.{name}" if owner and owner[1] == "class" else name), name, m.start(4), end.end() if end else len(s.text.rstrip()), _above(s, m.start(), "ruby")


# ---- Languages with braces ----

_TYPE_WORD = {
    "typescript": r"\b(?:class|interface|enum)\s+(\w+)",
    "java": r"\b(?:class|interface|enum|record)\s+(\w+)",
    "csharp": r"\b(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(\w+)",
    "rust": r"\bimpl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(?:[^{;]*?\bfor\s+)?(?:[&\w:\s]*::)?\s*(?:&|dyn\s+|mut\s+)*(\w+)|\btrait\s+(\w+)",
    "go": r"(?!)",
    "kotlin": r"\b(?:class|interface|object)\s+(\w+)",
    "dart": r"\b(?:class|mixin|extension|enum)\s+(\w+)",
}
_TYPE_WORD["javascript"] = _TYPE_WORD["typescript"]
_TYPES = {k: re.compile(v) for k, v in _TYPE_WORD.items()}
_NOT_A_NAME = {"if", "for", "while", "switch", "catch", "with", "return", "new", "function", "do", "else", "try", "using", "lock", "fixed", "foreach", "synchronized", "super", "this", "throw", "await", "yield", "when", "unsafe", "checked", "unchecked", "match", "loop", "typeof", "instanceof", "in", "of", "delete", "void", "case", "default"}
_JS_FUNCTION = re.compile(r"\bfunction\b\s*\*?\s*([\w$]+)\s*(?=[(<])")
_JS_CONST = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=]*?(?:=>[^=]*?)*)?=\s*(?:async\b\s*)?(?:function\b|<|\(|[\w$]+\s*=>)")
_JS_MEMBER = re.compile(r"(?:^|[\s*}])(#?[\w$]+)\s*(?:<[^{}()]*>)?\s*(?=\()")
_JS_FIELD = re.compile(r"(?:^|\s)(#?[\w$]+)\s*(?::[^=]*?)?=\s*(?:async\b\s*)?(?:function\b|\(|[\w$]+\s*=>)")
_C_MEMBER = re.compile(r"(?<![\w.@])(\w+)\s*(?:<[^{}()]*>)?\s*(?=\()")
_RUST_FUNCTION = re.compile(r"\bfn\s+(?:r#)?(\w+)")
_KOTLIN_FUNCTION = re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*(?=\()")
_GO_FUNCTION = re.compile(r"\bfunc\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)\s*(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?=[(\[])")
_ANNOTATION = {"java": re.compile(r"\s*@(?!interface\b)[\w.]+\s*"), "csharp": re.compile(r"\s*(?=\[)"), "typescript": re.compile(r"\s*@[\w.$]+\s*"), "rust": re.compile(r"\s*#!?\s*(?=\[)")}
_ANNOTATION["javascript"] = _ANNOTATION["kotlin"] = _ANNOTATION["dart"] = _ANNOTATION["typescript"]


def _skip_annotations(code: str, at: int, end: int, language: str) -> int:
    """The place of the first token behind annotations or attributes."""
    pattern = _ANNOTATION.get(language)
    while pattern:
        m = pattern.match(code, at, end)
        if not m or (m.end() == at and not code.startswith("[", at)):
            break
        at = m.end()
        if at < end and code[at] in "([":
            at = _close(code, at, "()" if code[at] == "(" else "[]")
    while at < end and code[at].isspace():
        at += 1
    return min(at, end)


def _own_line(code: str, start: int, end: int, in_type: bool, language: str) -> int:
    """Where the declaration itself begins, in languages whose statements before it need no semicolon."""
    if language not in ("go", "typescript", "javascript"):
        return start
    f = _signature(code, start, end, in_type, language)
    if not f:
        return start
    word = code.rfind("func", start, f[1]) if language == "go" else f[1]
    first = code.rfind("\n", 0, word if word >= 0 else f[1]) + 1
    while first < end and code[first].isspace():
        first += 1
    return max(start, first)


def _signature(code: str, start: int, end: int, in_type: bool, language: str) -> tuple[str, int, str | None] | None:
    """(name, place of the name, Go receiver) of the function whose header lies in code[start:end]."""
    head = code[start:end]
    if language in ("typescript", "javascript"):
        if m := _JS_FUNCTION.search(head):
            return m.group(1), start + m.start(1), None
        if not in_type and (m := _JS_CONST.search(head)):
            return m.group(1), start + m.start(1), None
        if in_type and (re.search(r"=>\s*$", head) or re.search(r"=\s*(?:async\s+)?function", head)):
            m = _JS_FIELD.search(head)
            return (m.group(1), start + m.start(1), None) if m else None
        for m in _JS_MEMBER.finditer(head) if in_type else ():
            rest = head[_close(head, m.end(), "()") :].strip()
            if m.group(1) not in _NOT_A_NAME and (not rest or rest[0] == ":"):
                return m.group(1), start + m.start(1), None
        return None
    if language == "rust":
        m = _RUST_FUNCTION.search(head)
        return (m.group(1), start + m.start(1), None) if m else None
    if language == "kotlin":
        m = _KOTLIN_FUNCTION.search(head)
        return (m.group(1), start + m.start(1), None) if m else None
    if language == "go":
        m = _GO_FUNCTION.search(head)
        return (m.group(2), start + m.start(2), m.group(1)) if m else None
    first = re.match(r"\w+", head)
    if (not in_type and language == "java") or (first and first.group() in _NOT_A_NAME - {"unsafe", "new"}):
        return None
    if re.search(r"(?<![=!<>])=(?![=>])", _outside_brackets(head)) or re.search(r"\b(?:new|return|throw|await)\b", head):
        return None
    m = next((x for x in _C_MEMBER.finditer(head) if x.group(1) not in _NOT_A_NAME), None)
    # A method has a return type before its name; a constructor only modifiers.
    return (m.group(1), start + m.start(1), None) if m and head[: m.start(1)].strip() else None


def _outside_brackets(head: str) -> str:
    out, depth = [], 0
    for c in head:
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0:
            out.append(c)
    return "".join(out)


def _braces(s: Source, language: str) -> Iterator[tuple[str, str, int, int, str]]:
    code = s.code
    # Each open bracket: its character, the kind of its scope, the name of its type, the start of the segment inside it.
    stack: list[list] = [["", "top", None, 0]]
    for m in re.compile(r"[{}()\[\];]|=>").finditer(code):
        c, top = m.group(), stack[-1]
        if c == "{":
            head_start = top[3]
            begin = _skip_annotations(code, head_start, m.start(), language)
            kind, name = "block", None
            in_type = top[1] == "type"
            begin = _own_line(code, begin, m.start(), in_type, language)
            t = _TYPES[language].search(code, begin, m.start())
            f = _signature(code, begin, m.start(), in_type, language)
            if t and (not f or t.start() < f[1]) and "(" not in code[begin : t.start()]:
                kind, name = "type", t.group(1) or (t.group(2) if t.re.groups > 1 else None)
            elif f:
                kind = "function"
                yield _named(s, f, top, head_start, begin, _close(code, m.start(), "{}"), language)
            stack.append(["{", kind, name, m.end()])
        elif c in "([":
            stack.append([c, "bracket", None, m.end()])
        elif c in "])":
            if stack[-1][0] == {"]": "[", ")": "("}[c]:
                stack.pop()
        elif c == "}":
            # A stray closer ends the brackets opened since its brace; without an open brace it is water.
            if any(x[0] == "{" for x in stack):
                while stack[-1][0] != "{":
                    stack.pop()
                stack.pop()
            stack[-1][3] = m.end()
        elif c == ";":
            if language == "rust" and top[1] == "bracket":
                continue
            if top[1] != "bracket" and (f := _bodiless(code, top, m.start(), language)):
                begin = _own_line(code, _skip_annotations(code, top[3], m.start(), language), m.start(), top[1] == "type", language)
                yield _named(s, f, top, top[3], begin, m.end(), language)
            top[3] = m.end()


def _bodiless(code: str, top: list, end: int, language: str):
    """An arrow function or an expression body that ends at `end`."""
    start = _skip_annotations(code, top[3], end, language)
    head = code[start:end]
    if "=>" not in head or language not in ("typescript", "javascript", "csharp"):
        return None
    if language == "csharp":
        return _signature(code, start, start + head.index("=>"), top[1] == "type", language)
    return None if "{" in head else _signature(code, start, end if top[1] != "type" else start + head.index("=>") + 2, top[1] == "type", language)


def _named(s: Source, f: tuple, top: list, head_start: int, begin: int, end: int, language: str) -> tuple[str, str, int, int, str]:
    name, place, receiver = f
    owner = receiver or (top[2] if top[1] == "type" else None)
    return (f"{owner}.{name}" if owner else name), name, place, end, _above(s, begin, language, head_start)


# ---- Documentation ----


def _above(s: Source, begin: int, language: str, low: int = 0) -> str:
    """The documentation comment above the declaration at `begin` in the form usual for the language, or ''."""
    notes = s.notes_above(begin, low)
    if language in ("go", "ruby"):
        lines, line = [], s.line(begin)
        for a, b, kind in notes:
            if s.line(max(a, b - 1)) != line - 1 or s.code[s.text.rfind("\n", 0, a) + 1 : a].strip():
                break
            lines.append((s.text[a:b], kind))
            line = s.line(a)
            if kind == "block":
                break
        return "\n".join(_strip_comment(t, k, language) for t, k in reversed(lines))
    if language in ("rust", "csharp", "dart"):
        lines, line = [], None
        for a, b, kind in notes:
            t = s.text[a:b]
            doc = kind == "line" and t.startswith("///") and not t.startswith("////")
            if not doc:
                if lines:
                    break
                continue  # plain comments may stand between, like attributes
            if (line is not None and s.line(a) != line - 1) or (line is None and _skip_annotations(s.code, b, begin, language) < begin):
                break
            lines.append(t[3:])
            line = s.line(a)
        return "\n".join(reversed(lines))
    for a, b, kind in notes:
        t = s.text[a:b]
        if kind == "block" and t.startswith("/**") and len(t) > 4:
            return _strip_comment(t, kind, language) if _skip_annotations(s.code, b, begin, language) == begin else ""
        if kind == "block":
            break
    return ""


def _strip_comment(t: str, kind: str, language: str) -> str:
    if kind == "line":
        t = t[2:] if t.startswith("//") else t.lstrip("#")
        # Directives for tools are no documentation.
        return "" if re.match(r"(?:go:|nolint|line |\+build|!|\s*(?:frozen_string_literal|encoding|rubocop):)", t) else t.strip()
    if language == "ruby":
        return re.sub(r"^=(?:begin|end)[^\n]*$", "", t, flags=re.M)
    t = t.removesuffix("*/")
    t = re.sub(r"^/\*+", "", t)
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x).strip() if i else x.strip() for i, x in enumerate(t.split("\n")))


def language_of(path: str | None, named: str | None) -> str | None:
    end = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)
    return EXTENSIONS.get(end[1].lower()) if len(end) == 2 and end[1].lower() in EXTENSIONS else NAMES.get((named or "").strip().lower())


def functions(text: str | None, language: str | None, source: Source | None = None) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(qualified name, name, line of the name, last line, documentation, code) of every function, documented or not. source: the text's, where it is at hand."""
    if not text or language not in _TOKEN:
        return
    s = source or Source(text, language)
    found = _python(s) if language == "python" else _ruby(s) if language == "ruby" else _braces(s, language)
    for qualified, name, place, end, doc in found:
        first = s.text.rfind("\n", 0, place) + 1
        yield qualified, name, s.line(place), s.line(max(place, end - 1)), doc, s.text[first:end]
