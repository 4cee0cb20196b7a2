"""What changes in XML, JavaScript and other files touch: elements with their table, functions with their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of files(file, content); null contents give nothing."""
    return files.where("content is not null").select("file", F.posexplode(F.split("content", r"\r?\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line_no"), "text")


def xml_columns(lines: DataFrame) -> DataFrame:
    """(file, line_no, table, column, data_type): <column> elements with the table that is open at their line.

    The table is carried forward line by line until </table>, within a file; columns outside of tables have none.
    """
    t = F.col("text")
    opened = F.regexp_extract(t, r"""<table\b[^<>]*?\bname\s*=\s*["']([^"'<>]*)["']""", 1)
    marked = lines.where(t.contains("<table") | t.contains("</table") | t.contains("<column"))
    # lines that open or close one of the two; the name of an open table, or an empty text
    marked = marked.withColumn("mark", F.when(opened != "", opened).when(t.contains("</table"), ""))
    carried = F.last("mark", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    name = F.regexp_extract(t, r"""<column\b[^<>]*?\bname\s*=\s*["']([^"'<>]*)["']""", 1)
    kind = F.regexp_extract(t, r"""<column\b[^<>]*?\btype\s*=\s*["']([^"'<>]*)["']""", 1)
    found = marked.withColumn("table", carried).withColumn("column", name).where("column <> ''")
    return found.select("file", "line_no", F.when(F.col("table") != "", F.col("table")).alias("table"), "column", kind.alias("data_type"))


def xml_impact(columns: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, tables, n_columns, risk) of hunks(file, h_start, h_end): columns on the hunks' lines; MEDIUM if there are any, else LOW."""
    hit = hunks.join(columns, "file").where("line_no between h_start and h_end")
    found = hit.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"), F.count_distinct("table", "column").alias("n_columns"))
    return hunks.select("file").distinct().join(found, "file", "left").select(
        "file", F.coalesce("tables", F.lit("")).alias("tables"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.when(F.col("n_columns") > 0, "MEDIUM").otherwise("LOW").alias("risk")
    )


_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<text>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|.)", re.S
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > => return typeof case in of".split())


def js_functions(text: str) -> list[tuple[str, str, int, int]]:
    """(name, parent, first line, last line) of the named functions of a script; [] when its brackets don't match.

    Named are declarations, methods, and functions or arrows with a body that are assigned to a variable or a key.
    """
    tokens: list[tuple[str, int, str]] = []
    pos, line, close, stack = 0, 1, {}, []
    while pos < len(text):
        last = tokens[-1][0] if tokens else "("
        m = (_REGEX.match(text, pos) if text[pos] == "/" and last in _BEFORE_REGEX else None) or _TOKEN.match(text, pos)
        s, kind = m[0], m.lastgroup or ("text" if m.re is _REGEX else None)
        if kind:
            if s in ("(", "[", "{") and kind == "op":
                stack.append(len(tokens))
            elif s in (")", "]", "}") and kind == "op":
                if not stack or tokens[stack[-1]][0] + s not in ("()", "[]", "{}"):
                    return []
                close[stack.pop()] = len(tokens)
            tokens.append((s if kind != "text" else '"', line, kind))
        line += s.count("\n")
        pos = m.end()
    if stack:
        return []
    word = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
    is_id = lambda i: 0 <= i < len(tokens) and tokens[i][2] == "id"
    found: list[tuple[str, int, int]] = []
    for i, (s, _, kind) in enumerate(tokens):
        name, at = "", -1
        if s == "function" and kind == "id":
            j = i + 1 + (word(i + 1) == "*")
            at = j + is_id(j)
            back = i - 1 - (word(i - 1) == "async")
            name = word(j) if is_id(j) else word(back - 1) if word(back) in ("=", ":") and is_id(back - 1) else ""
        elif s == "(" and i in close and word(close[i] + 1) == "=>" and word(close[i] + 2) == "{":
            back = i - 1 - (word(i - 1) == "async")
            name, at = (word(back - 1) if word(back) in ("=", ":") and is_id(back - 1) else ""), i
        elif kind == "id" and word(i + 1) == "(" and word(i - 1) in ("{", "}", ",", ";") and s not in ("if", "for", "while", "switch", "catch", "with", "function"):
            name, at = s, i + 1
        if name and at in close:
            body = close[at] + 1 + (word(close[at] + 1) == "=>")
            if word(body) == "{":
                found.append((name, i, close[body]))
    out = []
    for name, a, b in found:
        around = [n for n, x, y in found if x < a and b <= y]
        out.append((name, around[-1] if around else "", tokens[a][1], tokens[b][1]))
    return out


def script_functions(files: DataFrame) -> DataFrame:
    """(file, name, parent, start_line, end_line) of the functions of files(file, content)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(f, *row) for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in js_functions(text)]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 5, types)], names=["file", "name", "parent", "start_line", "end_line"])

    return files.where("content is not null").select("file", "content").mapInArrow(work, "file string, name string, parent string, start_line int, end_line int")


def callers_of_scripts(scripts: DataFrame, calls: DataFrame, urls: DataFrame, methods: DataFrame) -> DataFrame:
    """(file, url, fqn): scripts to the URLs that they call, exactly or before a query, and on to the methods behind them.

    scripts: file; calls: file, used; urls: url, src; methods: fqn.
    """
    from wakegraph.operators.merge import link_by_prefix

    linked = link_by_prefix(calls.join(scripts.select("file").distinct(), "file", "left_semi").select(F.col("file").alias("user"), "used"), urls.select("url").distinct())
    return linked.join(urls, "url").join(methods.select(F.col("fqn").alias("src")), "src", "left_semi").select(F.col("user").alias("file"), "url", F.col("src").alias("fqn")).distinct()


def owner_facts(owners: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """owners(owner) with one sorted list a branch (owner, value), `,` between; each branch is grouped before it is joined."""
    out = owners.select("owner").distinct()
    for name, df in branches.items():
        out = out.join(df.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias(name)), "owner", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def feature_pivot(features: DataFrame) -> DataFrame:
    """features(kind, owner, n) to one row a kind with n_owners and total, and a row `all`."""
    return features.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("total")).unionByName(
        features.agg(F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("total")).select(F.lit("all").alias("kind"), "n_owners", "total")
    )
