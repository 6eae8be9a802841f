
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space, with the four information separators. Java's \s is ASCII.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same class as RE2 spells it, for SQL that DuckDB runs.
WS_RE2 = r"[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapse(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def norm_code(c: Column | str) -> Column:
    """B1: each line up to its first #, blank lines dropped, white space collapsed. A # in a string counts too."""
    return collapse(F.regexp_replace(_c(c), r"#[^\n]*", ""))


def chash(c: Column | str) -> Column:
    """B2: SHA-1 in hex."""
    return F.sha1(_c(c).cast("binary"))


def content_key(*columns: Column) -> Column:
    """One hash of several normalised parts, kept apart by NUL."""
    return F.sha1(F.concat_ws("\x00", *columns).cast("binary"))


def norm_text(c: Column | str) -> Column:
    """White space collapsed, lower case."""
    return F.lower(collapse(c))


def strip_fences(c: Column | str, tag: str = "[a-z]*") -> Column:
    """What stands in a text that is one fenced block as a whole, else the text."""
    whole = rf"(?s)\A{WS}*```(?:{tag})?{WS}*\n(.*?)\n?{WS}*```{WS}*\z"
    return F.when(_c(c).rlike(whole), F.regexp_extract(_c(c), whole, 1)).otherwise(_c(c))


def strict_fence(c: Column | str, tag: str) -> Column:
    """The body of a text that is exactly one fenced block of that tag, else null."""
    exact = rf"(?s)\A```{tag}\n(.*)\n```{WS}*\z"
    return F.when(_c(c).rlike(exact), F.regexp_extract(_c(c), exact, 1))


def extract_code(c: Column | str, tag: str) -> Column:
    """After the first fence with the tag, up to the next; else what stands between the first and the last fence, after the
    first if there is no other; else all. Trimmed."""
    text, mark = _c(c), f"```{tag}"
    tagged, rest = F.element_at(F.split(text, mark, 2), -1), F.element_at(F.split(text, "```", 2), -1)
    between = F.when(rest.contains("```"), F.regexp_extract(rest, r"(?s)\A(.*)```", 1)).otherwise(rest)
    return ws_trim(F.when(text.contains(mark), F.substring_index(tagged, "```", 1)).when(text.contains("```"), between).otherwise(text))


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def fence(c: Column | str, tag: str) -> Column:
    """Trimmed text as a fenced block."""
    return F.concat(F.lit(f"```{tag}\n"), ws_trim(_c(c)), F.lit("\n```"))


def leak_norm(c: Column | str, tag: str) -> Column:
    """The fence's body, or all; comments cut, lines trimmed, blank ones dropped. Not the same as norm_code."""
    found = rf"(?s)```(?:{tag})?{WS}*\n(.*?)```"
    body = F.when(_c(c).rlike(found), F.regexp_extract(_c(c), found, 1)).otherwise(_c(c))
    lines = F.transform(F.split(body, "\n"), lambda x: ws_trim(F.regexp_replace(x, "#.*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def count_tests(c: Column | str) -> Column:
    """Lines that open a named test. UNIX_LINES, or Java would break lines at more characters."""
    return F.regexp_count(_c(c), F.lit(rf'(?md)^{WS}*test{WS}+"'))


def count_test_lines(c: Column | str) -> Column:
    """B11."""
    return F.regexp_count(_c(c), F.lit(rf"(?md)^test{WS}"))


def as_int(c: Column) -> Column:
    """-1 for what is no integer."""
    return F.coalesce(c.try_cast("bigint"), F.lit(-1).cast("bigint"))


def provenance(corpus: Column, commit: Column, path: Column, id_: Column) -> Column:
    """Corpus:commit:path#id=N."""
    return F.concat(F.concat_ws(":", corpus, commit, path), F.lit("#id="), id_.cast("string"))


def provenance_id(origin: Column) -> Column:
    """B13, read back: what stands after #id=, -1 if no integer."""
    return as_int(F.split_part(origin, F.lit("#id="), F.lit(2)))


def tier(status: Column) -> Column:
    """Floor before idiomatic before cleaned."""
    return F.when(status.contains("floor"), "floor").when(status.contains("idiom"), "idiomatic").otherwise("cleaned")


def error_signature(c: Column | str, width: int = 80) -> Column:
    """What stands in single quotes (two characters or more) as 'x', what stands between `return type` and the line's last
    `but` as T, at most `width` characters."""
    quoted = F.regexp_replace(_c(c), "'[^']{2,}'", "'x'")
    return F.substring(F.regexp_replace(quoted, "(?d)return type .* but", "return type T but"), 1, width)


def first_error(c: Column | str, width: int = 120) -> Column:
    """`E1: message` of the first error[E1]: message, else the last line of the output, cut to `width`; empty of an empty one."""
    found = F.regexp_extract(_c(c), r"(error\[(E\p{Nd}+)\]: ([^\n]*))", 1)
    last = F.regexp_extract(ws_trim(_c(c)), r"([^\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]*)\z", 1)
    return F.when(found != "", F.regexp_replace(found, r"(?s)\Aerror\[(E\p{Nd}+)\]", "$1")).otherwise(F.substring(last, 1, width))


def regex_sum(c: Column | str, pattern: str) -> Column:
    """Sum of all captures of a pattern with one group."""
    return F.aggregate(F.transform(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(1)), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def format_flags(c: Column | str) -> dict[str, Column]:
    """How an answer is written: fenced, fenced as Python, with a signature of its own, with a braced definition, with `func`."""
    text = _c(c)
    # fixed values: what each flag looks for
    patterns = {"python_fence": r"```(python|py)\b", "signature": r"\bdef \w+\(", "braced_def": r"\bdef \w+\(.*\)\s*(->[^{]*)?\{", "func_keyword": r"\bfunc \w+"}
    return {"fenced": text.contains("```")} | {name: text.rlike(f"(?Ud){p}") for name, p in patterns.items()}


def prefixed_id(prefix: str, id_: Column) -> Column:
    """An id under a prefix."""
    return F.concat(F.lit(prefix), id_.cast("string"))


def json_get(c: Column | str, *path: str) -> Column:
    """What stands at a path of keys in a JSON text, as text; null where any step is missing, not an object, or null."""
    return F.get_json_object(c, "$" + "".join(f"['{k}']" for k in path))


def schema_bullets(c: Column | str) -> Column:
    """A bullet for each node declared in a text, with its fields as name: type."""
    bodies = F.regexp_extract_all(_c(c), F.lit(r"(?s)\bnode\s+(\w+)\s*\{([^}]*)\}"), F.lit(0))

    def bullet(body: Column) -> Column:
        fields = F.regexp_extract_all(body, F.lit(r"\bhas\s+(\w+\s*:\s*[\w\[\], |]+)"), F.lit(1))
        return F.concat(F.lit("- "), F.regexp_extract(body, r"node\s+(\w+)", 1), F.lit("("), F.array_join(F.transform(fields, collapse), ", "), F.lit(")"))

    return F.array_join(F.transform(bodies, bullet), "\n")


def percent_floor(part: Column, whole: Column) -> Column:
    """Floored integer percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.floor(part.cast("bigint") * 100 / F.when(whole != 0, whole))).cast("bigint")


def license_line(c: Column | str) -> Column:
    """The name in a text's license line, upper case; empty if it has none."""
    return F.upper(F.regexp_extract(_c(c), r"(?i)(?:licensed under(?: the)?|released under the) ([A-Za-z0-9 .\-]*?)(?: Public)?(?: License|,|\.$|\.\n)", 1))
