"""Key and string functions as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The detector patterns whose tools share one location, so that their key needs the tool's name.
SHARED_LOCATION_PATTERNS = ("python.list_tools_lowlevel", "typescript.set_request_handler_lowlevel", "javascript.set_request_handler_lowlevel")


def tool_uid_for(repo: Column, qualified_name: Column, file: Column, start_line: Column, name: Column, pattern: Column) -> Column:
    """repo::qualified_name::file:line, with ::name for patterns whose tools share a handler."""
    base = F.concat(repo, F.lit("::"), qualified_name, F.lit("::"), file, F.lit(":"), start_line.cast("string"))
    return F.when(pattern.isin(*SHARED_LOCATION_PATTERNS), F.concat(base, F.lit("::"), name)).otherwise(base)


def tool_key(uid: Column, name: Column) -> Column:
    """The uid with exactly one ::name at its end; without a name the uid itself."""
    suffix = F.concat(F.lit("::"), name)
    bare = F.when(F.endswith(uid, suffix), F.left(uid, F.length(uid) - F.length(suffix))).otherwise(uid)
    return F.when(name.isNull(), uid).otherwise(F.concat(bare, suffix))


def checkpoint_key(uid: Column, scenario: Column, judge: Column) -> Column:
    return F.concat_ws("::", uid, scenario, judge)


def repo_of_uid(uid: Column) -> Column:
    """The part before the first '::'."""
    return F.substring_index(uid, "::", 1)


def slug_of_repo(name_with_owner: Column) -> Column:
    """owner/name -> owner__name (first slash)."""
    return F.regexp_replace(name_with_owner, "^([^/]*)/", "$1__")


def safe_file_name(c: Column) -> Column:
    """Everything but letters, digits, '-', '_' and '.' becomes '_'."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_")


def truncate_with_notice(c: Column, limit: int = 32_000, notice: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(notice))).otherwise(c)


#: What ends a line.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
LAST_END = "(?:" + LINE_END + r")\z"


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1, both included; LF, CRLF and the other line ends of Unicode end a line, put together with LF."""
    lines = F.split(F.regexp_replace(text, LAST_END, ""), LINE_END, -1)
    size = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))
    return F.when(start.isNull() | end.isNull() | (start < 1), None).otherwise(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), size), "\n"))


def first_json_object(c: Column) -> Column:
    """From the first '{' to the last '}', '' if there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def shard_for(uid: Column, shards: int) -> Column:
    """The SHA-256 of the uid as an integer modulo `shards` (below 2^58)."""
    digits = F.sha2(uid, 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda a, i: (a * 16 + F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("long")) % shards)


def mask_secret(c: Column, shown: int = 4) -> Column:
    return F.when(F.length(c) <= shown, F.repeat(F.lit("*"), F.length(c).cast("int"))).otherwise(F.concat(F.left(c, F.lit(shown)), F.lit("…")))


def escape_latex(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def ascii_slug(c: Column) -> Column:
    """File-name part: accents folded, other signs than letters and digits to '_', none at the ends, lower case.

    Folding covers the letters that decompose into a Latin letter and marks; letters without such a form are dropped.
    """
    folded = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(folded, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def _foldings() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII letter with marks, and that letter; from Unicode's own tables."""
    import unicodedata

    found = {}
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalnum():
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _foldings()


def scientific(c: Column, digits: int = 2) -> Column:
    """A small number in LaTeX as mantissa and power of ten with a decimal comma; 0 as below the least double; null stays null."""
    text = F.format_string(f"%.{digits}e", c)
    mantissa, power = F.replace(F.split(text, "e")[0], F.lit("."), F.lit(",")), F.split(text, "e")[1].cast("int").cast("string")
    return F.when(c == 0, F.lit("$< 10^{-300}$")).when(c.isNotNull(), F.concat(F.lit("$"), mantissa, F.lit(r" \times 10^{"), power, F.lit("}$")))


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Every floating column, also inside structs and arrays, rounded half to even."""
    return df.select(*(_round_type(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema.fields))


def _round_type(c: Column, kind: T.DataType, digits: int) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.bround(c, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _round_type(x, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _k, v: _round_type(v, kind.valueType, digits))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_round_type(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields)))
    return c


def decimal_comma(c: Column, digits: int) -> Column:
    """A number with a decimal comma; null stays null."""
    return F.when(c.isNotNull(), F.replace(F.format_string(f"%.{digits}f", c), F.lit("."), F.lit(",")))


def in_peak_window(ts: Column) -> Column:
    """UTC weekdays (Monday to Friday), hours 1-3 and 6-9."""
    h = F.hour(ts)
    return (F.weekday(ts) < 5) & (((h >= 1) & (h < 4)) | ((h >= 6) & (h < 10)))


def seconds_of_duration(c: Column) -> Column:
    """'1.500s' -> 1.5; other texts give null."""
    return F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)s\s*$", 1).try_cast("double")


def seconds_until(ts: Column, now: Column) -> Column:
    """Whole seconds from `now` to `ts`, never negative."""
    return F.greatest(F.unix_timestamp(ts) - F.unix_timestamp(now), F.lit(0))
