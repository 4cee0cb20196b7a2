"""Configuration and test descriptions: XML by row tags, seed XML by patterns, Markdown tables, rules, registries."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = r"""([A-Za-z_][\w.-]*)\s*=\s*["']([^"'<>]*)["']"""


def elements(texts: DataFrame, tag: str) -> DataFrame:
    """(path, ord, attrs) of every start tag of that name in texts(path, content); attribute names in lower case.

    Attributes are read by pattern, so fragments without prolog or root are read too. Null texts give nothing.
    """
    found = texts.where("content is not null").select("path", F.posexplode(F.regexp_extract_all("content", F.lit(rf"(?is)<{tag}\b([^<>]*)>"), 1)).alias("ord", "body"))
    names, values = F.transform(F.regexp_extract_all("body", F.lit(_ATTRIBUTE), 1), F.lower), F.regexp_extract_all("body", F.lit(_ATTRIBUTE), 2)
    # of an attribute written twice the first counts
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == F.array_position(pairs, p))
    return found.select("path", "ord", F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"]))).alias("attrs"))


def attribute(name: str) -> Column:
    return F.col("attrs")[name.lower()]


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of an XML file by row tag; attributes are columns with a leading underscore."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def servlets(spark: SparkSession, path: str) -> DataFrame:
    """(name, class_fqn, url) of a web descriptor: servlets joined with their mappings, wildcard patterns left out."""
    defined = xml_rows(spark, path, "servlet", "`servlet-name` string, `servlet-class` string").select(F.trim("servlet-name").alias("name"), F.trim("servlet-class").alias("class_fqn"))
    mapped = xml_rows(spark, path, "servlet-mapping", "`servlet-name` string, `url-pattern` array<string>").select(F.trim("servlet-name").alias("name"), F.explode("url-pattern").alias("url"))
    return defined.join(mapped.select("name", F.trim("url").alias("url")), "name").where(~F.col("url").contains("*")).distinct()


def secured_urls(texts: DataFrame) -> DataFrame:
    """(url, api_method) of <url path= apimethod=>."""
    return elements(texts, "url").select(attribute("path").alias("url"), attribute("apimethod").alias("api_method")).where("url is not null").distinct()


def api_mappings(texts: DataFrame, tag: str) -> DataFrame:
    """(url, class_fqn, call): rows without a URL are left out; URLs get a leading slash."""
    url = attribute("API_URL")
    slashed = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    return elements(texts, tag).where(url.isNotNull()).select(slashed.alias("url"), attribute("SERVLET_CLASS_NAME").alias("class_fqn"), attribute("MTCALL_VALUE").alias("call")).distinct()


def servlet_apis(texts: DataFrame, tag: str) -> DataFrame:
    """(url, class_fqn, method): all three are required."""
    return elements(texts, tag).select(attribute("URL_PATH").alias("url"), attribute("CLASS_NAME").alias("class_fqn"), attribute("METHOD_NAME").alias("method")).dropna().distinct()


def actions(texts: DataFrame) -> DataFrame:
    """(url, class_fqn, parameter) of <action path= type= parameter=>, with the suffix .do."""
    a = elements(texts, "action").where(attribute("path").isNotNull())
    return a.select(F.concat(attribute("path"), F.lit(".do")).alias("url"), attribute("type").alias("class_fqn"), attribute("parameter").alias("parameter")).distinct()


def action_methods(actions_: DataFrame, methods: DataFrame) -> DataFrame:
    """(url, target): path.do?param=method for dispatching actions, path.do on the class for those without methods.

    methods: owner, simple.
    """
    hit = actions_.join(methods.select(F.col("owner").alias("class_fqn"), "simple").distinct(), "class_fqn")
    full = hit.select(F.when(F.col("parameter").isNull(), F.col("url")).otherwise(F.concat("url", F.lit("?"), "parameter", F.lit("="), "simple")).alias("url"), F.concat("class_fqn", F.lit("."), "simple").alias("target"))
    rest = actions_.join(methods.select(F.col("owner").alias("class_fqn")), "class_fqn", "left_anti").select("url", F.col("class_fqn").alias("target"))
    return full.unionByName(rest).distinct()


def forwards(texts: DataFrame, apis: DataFrame) -> DataFrame:
    """(url, forward, class_fqn): forwarded URLs joined with the API map of what they forward to."""
    f = elements(texts, "forward").select(attribute("url").alias("url"), attribute("to").alias("forward")).dropna()
    return f.join(apis.select(F.col("url").alias("forward"), "class_fqn"), "forward").distinct()


# Elements that define tasks, in the order in which they are read.
TASK_TAGS = ("TaskEngine_Task", "BackgroundTaskDetails")


def task_classes(texts: DataFrame, tags: tuple[str, ...] = TASK_TAGS) -> DataFrame:
    """(name, class_fqn): the last definition of a task name wins, by file and place in it."""
    out = None
    for n, tag in enumerate(tags):
        e = elements(texts, tag).select(attribute("task_name").alias("name"), attribute("class_name").alias("class_fqn"), F.struct("path", F.lit(n), "ord").alias("at")).where("name is not null and class_fqn is not null")
        out = e if out is None else out.unionByName(e)
    return out.groupBy("name").agg(F.max_by("class_fqn", "at").alias("class_fqn"))


def data_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(table, name, data_type, max_size, nullable, pk_like) of <table><columns><column>; pk_like for unique value columns."""
    schema = (
        "_name string, columns struct<column: array<struct<_name: string, `data-type`: string, `max-size`: int, nullable: string>>>,"
        " `uniquevalue-generation`: struct<`uniquevalue-column`: array<string>>"
    ).replace("`uniquevalue-generation`:", "`uniquevalue-generation`")
    rows = xml_rows(spark, path, "table", schema)
    unique = F.coalesce(F.transform(F.col("`uniquevalue-generation`.`uniquevalue-column`"), lambda c: F.lower(F.trim(c))), F.array().cast("array<string>"))
    e = rows.select(F.col("_name").alias("table"), unique.alias("u"), F.explode("columns.column").alias("c"))
    return e.select(
        "table", F.col("c._name").alias("name"), F.col("c.data-type").alias("data_type"), F.col("c.max-size").alias("max_size"),
        (F.lower(F.coalesce("c.nullable", F.lit("true"))) != "false").alias("nullable"), F.array_contains("u", F.lower("c._name")).alias("pk_like"),
    )


def seed_classes(texts: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """(table, column, class_fqn): attribute values of seed rows that look like class names, by lower table, upper column.

    Texts of more than max_bytes are skipped, which is the operator's rule.
    """
    small = texts.where(F.octet_length("content") <= max_bytes)
    tags = small.select(F.explode(F.regexp_extract_all("content", F.lit(r"<([A-Za-z_]\w*\s[^<>]*)>"), 1)).alias("body"))
    pairs = tags.select(F.lower(F.regexp_extract("body", r"^(\w+)", 1)).alias("table"), F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(_ATTRIBUTE), 1).alias("k"), F.regexp_extract_all("body", F.lit(_ATTRIBUTE), 2).alias("v"))).alias("p"))
    return pairs.select("table", F.upper("p.k").alias("column"), F.col("p.v").alias("class_fqn")).where(F.col("class_fqn").rlike(r"^[a-z_]\w*(\.\w+)*\.[A-Z]\w*$")).distinct()


def table_candidates(wanted: DataFrame, seeds: DataFrame, columns: list[str], cap: int = 250) -> DataFrame:
    """(table, column, n, classes): of each wanted table the classes of the first listed column that has any.

    A table with more than `cap` classes has none, which is the operator's rule; it comes out with n and no classes.
    """
    prio = F.try_element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))]), F.col("column"))
    s = seeds.withColumn("prio", prio).where("prio is not null")
    counted = s.groupBy("table", "column", "prio").agg(F.count_distinct("class_fqn").alias("n"))
    best = wanted.select(F.lower("table").alias("table")).distinct().join(counted, "table").groupBy("table").agg(F.min(F.struct("prio", "column", "n")).alias("b")).select("table", "b.column", "b.n")
    listed = s.join(best.where(F.col("n") <= cap), ["table", "column"], "left_semi").groupBy("table").agg(F.array_sort(F.collect_set("class_fqn")).alias("classes"))
    return best.join(listed, "table", "left")


def markdown_cases(texts: DataFrame, prefix: str = "LBF") -> DataFrame:
    """(test_id, title, area, steps, expected, source) of Markdown tables in texts(path, content).

    Rows need five cells and an id of the form prefix-AREA-NN; separators and headers are skipped; parentheses go from ids.
    """
    rows = texts.where("content is not null").select("path", F.explode(F.split("content", r"\r?\n")).alias("line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.slice(F.split(F.trim("line"), r"\|"), 2, 99), lambda c: F.trim(c))
    c = rows.select("path", cells.alias("c")).where(F.size("c") >= 6).withColumn("id", F.regexp_replace(F.try_element_at("c", F.lit(1)), r"[()`*]", ""))
    return c.where(F.col("id").rlike(rf"^{prefix}-[A-Z]+-\d+$")).select(
        F.col("id").alias("test_id"), F.try_element_at("c", F.lit(2)).alias("title"), F.regexp_extract("id", rf"^{prefix}-([A-Z]+)-", 1).alias("area"),
        F.try_element_at("c", F.lit(3)).alias("steps"), F.try_element_at("c", F.lit(4)).alias("expected"), F.col("path").alias("source"),
    )


# Header names of test sheets, in lower case.
SHEET_COLUMNS = {
    "test_id": ("id", "test id", "test case id", "tc id"), "title": ("title", "name", "summary", "test case"), "area": ("area", "module", "feature"),
    "steps": ("steps", "test steps", "procedure"), "expected": ("expected", "expected result", "expected results"),
}


def sheet_cases(rows: list[list[str]], source: str) -> list[dict[str, str]]:
    """Test cases of a sheet's rows: the header is looked for in the first 20 rows; missing columns are empty."""
    for n, row in enumerate(rows[:20]):
        low = [str(c or "").strip().lower() for c in row]
        at = {k: next((low.index(s) for s in names if s in low), -1) for k, names in SHEET_COLUMNS.items()}
        if at["test_id"] >= 0 and at["title"] >= 0:
            cell = lambda r, k: str(r[at[k]] or "").strip() if 0 <= at[k] < len(r) else ""
            return [{k: cell(r, k) for k in SHEET_COLUMNS} | {"source": source} for r in rows[n + 1 :] if cell(r, "test_id")]
    return []


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_rows(data: bytes) -> list[list[str]]:
    """The cells of a workbook's (.xlsx) first sheet as text, row by row; columns that a row leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{_SHEET}row") if sheets else ():
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * max(0, at - 1 - len(cells))
                value = c.find(f"{_SHEET}v")
                plain = value.text or "" if value is not None else ""
                cells.append(text(c) if c.get("t") == "inlineStr" else shared[int(plain)] if c.get("t") == "s" and plain else plain)
            out.append(cells)
        return out


def workbook_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of the workbooks below path, as of sheet_cases; a file that is no workbook fails the job."""
    columns = [*SHEET_COLUMNS, "source"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [case for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for case in sheet_cases(workbook_rows(data), file)]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.string()) for c in columns], names=columns)

    books = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return books.select(F.substring_index("path", "/", -1).alias("path"), "content").mapInArrow(work, ", ".join(f"{c} string" for c in columns))


def csv_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of CSV sheets with a header line, columns named as in SHEET_COLUMNS."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    low = {c.strip().lower(): c for c in raw.columns}
    pick = lambda k: next((F.col(f"`{low[s]}`") for s in SHEET_COLUMNS[k] if s in low), F.lit(""))
    return raw.select(*[F.coalesce(F.trim(pick(k)), F.lit("")).alias(k) for k in SHEET_COLUMNS], F.lit(path).alias("source")).where("test_id <> ''")


class RuleFault(ValueError):
    """A line of a rule file that can't be read."""


def parse_rules(text: str) -> list[tuple[int, str, str, str, str]]:
    """(ord, test_id, op, kind, key) of a rule file: test ids at indent 0, ops at 2, `- kind: key` items from 4 on."""
    out: list[tuple[int, str, str, str, str]] = []
    test = op = None
    for n, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        body = body.strip()
        if indent == 0:
            if not body.endswith(":"):
                raise RuleFault(f"line {n}: a test id ends with a colon")
            test, op = body[:-1].strip(), None
        elif indent == 2:
            if test is None or body.rstrip(":") not in ("add", "remove") or not body.endswith(":"):
                raise RuleFault(f"line {n}: add: or remove: below a test id")
            op = body[:-1]
        elif indent >= 4:
            if op is None or not body.startswith("- ") or ":" not in body:
                raise RuleFault(f"line {n}: `- kind: key` below add or remove")
            kind, _, key = body[2:].partition(":")
            if not key.strip():
                raise RuleFault(f"line {n}: a key is missing")
            out.append((len(out), test, op, kind.strip(), key.strip()))
        else:
            raise RuleFault(f"line {n}: indent of {indent}")
    return out


def rules_of(texts: DataFrame) -> DataFrame:
    """(path, ord, test_id, op, kind, key) of rule files texts(path, content); a file that can't be read fails the job."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(path, *rule) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for rule in parse_rules(text)]
            columns = list(zip(*got)) if got else [()] * 6
            types = [pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "ord", "test_id", "op", "kind", "key"])

    return texts.where("content is not null").select("path", "content").mapInArrow(work, "path string, ord int, test_id string, op string, kind string, key string")


def registry_of(texts: DataFrame) -> DataFrame:
    """(macro_class, macro_key, placeholder, db_column) of JSON registries {class: [{key, placeholder, column}]}; what is no JSON gives nothing."""
    parsed = F.from_json("content", "map<string, array<struct<key: string, placeholder: string, column: string>>>")
    entries = texts.select(F.explode(parsed).alias("macro_class", "entries")).select("macro_class", F.explode("entries").alias("e"))
    return entries.select("macro_class", F.col("e.key").alias("macro_key"), F.col("e.placeholder").alias("placeholder"), F.col("e.column").alias("db_column"))


def macro_registry(text: str) -> list[tuple[str, str, str, str]]:
    """(macro_class, macro_key, placeholder, db_column) of a JSON registry {class: [{key, placeholder, column}]}."""
    data = json.loads(text)
    return [(cls, e.get("key", ""), e.get("placeholder", ""), e.get("column", "")) for cls, entries in sorted(data.items()) for e in entries]


def keys_of_columns(registry: DataFrame, columns: DataFrame) -> DataFrame:
    """(macro_class, keys) whose columns are among columns(db_column), in any letter case; keys sorted, `,` between."""
    hit = registry.join(columns.select(F.upper("db_column").alias("up")).distinct(), F.upper("db_column") == F.col("up"))
    return hit.groupBy("macro_class").agg(F.array_join(F.array_sort(F.collect_set("macro_key")), ",").alias("keys"))
