"""Column functions on names, paths, signatures and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of risks, natures (for merging rows and for ranking schedules) and evidence sources.
RISK_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
NATURE_RANK = {"BODY": 1, "SIGNATURE": 2, "ADDED": 3, "DELETED": 4}
SCHEDULE_NATURE_RANK = {"BODY": 1, "SIGNATURE": 2, "DELETED": 3, "ADDED": 4}
TABLE_SOURCE_RANK = {"both": 1, "schema-changed": 2, "java-reached": 3, "regression-safety": 4}

METHOD_FQN = r"^(.*)\.([^.(]+)\([^()]*\)$"


def rank(column: Column, ranks: dict[str, int], default: int = 0) -> Column:
    """The number of a name in a fixed order; `default` for null and unknown names."""
    pairs = [F.lit(x) for kv in ranks.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def name_of_rank(column: Column, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (v, k)])[column]


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def method_owner(fqn: Column) -> Column:
    """`a.b.C` of `a.b.C.m(T)`; empty if the text is no method name."""
    return F.regexp_extract(fqn, METHOD_FQN, 1)


def method_simple(fqn: Column) -> Column:
    return F.regexp_extract(fqn, METHOD_FQN, 2)


def signature_tail(fqn: Column) -> Column:
    """`m(T1,T2)`: what interface and implementation have in common."""
    return F.regexp_extract(fqn, r"([A-Za-z0-9_$<>]+\(.*\))$", 1)


def parameter_text(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"\((.*)\)\s*$", 1)


def without_generics(text: Column) -> Column:
    """The text without <...>, however deep: what stands where as many brackets have been closed as opened."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "<", 1).when(part == ">", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((state["depth"] == 0) & (depth == 0), F.concat(state["kept"], part)).otherwise(state["kept"]).alias("kept"))

    walked = F.aggregate(F.regexp_extract_all(text, F.lit("[<>]|[^<>]+"), 0), start, step, lambda state: state["kept"])
    return F.when(text.contains("<") | text.contains(">"), walked).otherwise(text)


def parameter_count(fqn: Column) -> Column:
    """Top-level parameters of a method name; null without parentheses, 0 for ()."""
    inner = F.trim(without_generics(parameter_text(fqn)))
    return F.when(fqn.contains("("), F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, ","))))


def parameter_types(fqn: Column) -> Column:
    """Simple names of the parameter types, without generics, packages and parameter names."""
    inner = F.trim(without_generics(parameter_text(fqn)))
    clean = F.transform(F.split(inner, r"\s*,\s*"), lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"^final\s+|\s+[\w$]+$", ""), r"^.*\.", ""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(clean)


def types_compatible(a: Column, b: Column) -> Column:
    """Pairwise equality of two equally long type lists, `?` standing for any type."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == "?") | (y == "?") | (x == y)), lambda ok: ok)


def short_method(fqn: Column) -> Column:
    """`Owner.method()` of a method name."""
    return F.concat(simple_name(method_owner(fqn)), F.lit("."), method_simple(fqn), F.lit("()"))


def camel_words(name: Column) -> Column:
    """`parseXMLFile` as `parse XML File`."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def camel_tokens(name: Column) -> Column:
    """Distinct lower-case words of more than one letter, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(camel_words(name)), r"[^a-z0-9]+"), lambda w: F.length(w) > 1)))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """Without the longest of the suffixes that it ends with."""
    ordered = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return F.regexp_replace(name, f"(?<=.)(?:{ordered})$", "")


def clean_path(path: Column) -> Column:
    """With `/`, without drive or checkout prefixes such as `a/`, `b/`, `./`."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./|[ab]/)", "")


def file_name(path: Column) -> Column:
    return F.substring_index(clean_path(path), "/", -1)


def source_path(path: Column) -> Column:
    """A source file's path below its source root (`java/`, else as it stands), without extension."""
    c = clean_path(path)
    below = F.regexp_extract(c, r"(?:^|/)java/(.+)\.[^./]*$", 1)
    return F.when(below != "", below).otherwise(F.regexp_extract(c, r"^(.*)\.[^./]*$", 1))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """Language of a changed file by its extension; `other` for the rest."""
    e = extension(path)
    return (
        F.when(e == "java", "java").when(e.isin("js", "hbs"), "javascript").when(e == "cs", "csharp").when(e == "xml", "xml")
        .when(e.isin("json", "properties", "sql"), "config").otherwise("other")
    )


def hunk_start(header: Column) -> Column:
    """First line on the new side of a hunk header."""
    return F.regexp_extract(header, r"\+(\d+)", 1).cast("int")


def literal_value(text: Column) -> Column:
    """Value of a literal: numbers without `_` and suffix, strings without quotes, booleans as they are; else null."""
    number = r"^-?\d[\d_]*[lL]?$"
    return (
        F.when(text.rlike(number), F.regexp_replace(text, "[_lL]", ""))
        .when(text.rlike(r'^"([^"\\]|\\.)*"$'), F.regexp_replace(text, '^"|"$', ""))
        .when(text.isin("true", "false"), text)
    )


def url_tail(url: Column) -> Column:
    """Last part of a URL, without its query; `servlet:` and `external:` names by their last part."""
    return F.try_element_at(F.filter(F.split(F.substring_index(url, "?", 1), "[/:]"), lambda p: p != ""), F.lit(-1))


def oxford_list(items: Column) -> Column:
    """`a`, `a and b`, `a, b, and c`."""
    n = F.size(items)
    return (
        F.when(n == 0, "").when(n == 1, F.try_element_at(items, F.lit(1))).when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at(items, F.lit(-1))))
    )


def change_nature(hunk_start: Column, hunk_end: Column, start: Column, end: Column) -> Column:
    """ADDED if the hunk covers the symbol, SIGNATURE if it reaches its first line from before, else BODY."""
    return F.when((hunk_start <= start) & (hunk_end >= end), "ADDED").when(hunk_start <= start, "SIGNATURE").otherwise("BODY")


def clamp(low: Column, high: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A hunk cut to the symbol; the symbol's own lines where they don't meet."""
    a, b = F.greatest(low, start), F.least(high, end)
    return F.when(a <= b, a).otherwise(start), F.when(a <= b, b).otherwise(end)


def exceeds(actual: Column, threshold: str) -> Column:
    """Whether a risk reaches the threshold; every risk reaches an unknown one."""
    return rank(actual, RISK_RANK) >= F.lit(RISK_RANK.get(threshold, 0))
