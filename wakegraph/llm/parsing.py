"""Source files that do not parse.

Every file is tried against all supported grammars, in the order in which its tokens speak for them. A file that its
own language's grammar refuses but another accepts has the wrong extension; one that all refuse is corrupt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakegraph.llm.syntax import CHECKS, parses

LANGUAGES = tuple(CHECKS)

_WORD = re.compile(r"[A-Za-z_]\w*|=>|===|</|/>|\":|::|->")
# Tokens that speak for a language.
_SIGNS = {
    "java": frozenset("package import class interface enum extends implements public private protected final void throws static int boolean String @ -> :: new return".split()),
    "js": frozenset("function const let var => === define require module exports undefined typeof return async await".split()),
    "xml": frozenset("</ /> xml xmlns CDATA DOCTYPE encoding version".split()),
    "json": frozenset('": true false null'.split()),
}


def language_of(path: Column) -> Column:
    """The judged language of a path's last extension, in any letter case; null for all others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(extension.isin(*LANGUAGES), extension)


def rank_languages(text: str) -> list[str]:
    """The languages, best first, by the share of tokens that speak for them."""
    seen: dict[str, int] = dict.fromkeys(LANGUAGES, 0)
    for token in _WORD.findall(text):
        for language, signs in _SIGNS.items():
            if token in signs:
                seen[language] += 1
    head = text.lstrip("﻿ \t\r\n")[:1]
    if head == "<":
        seen["xml"] += 1 + len(text)
    elif head in ("{", "["):
        seen["json"] += 10
    return sorted(LANGUAGES, key=lambda x: (-seen[x], x))


def judge_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, status, parses_as, likely) of every distinct file of a judged language with content.

    files: repo_id, path, content; other columns are ignored. language is that of the extension (java, xml, json, js).
    status is valid, wrong_extension (another grammar takes the whole text) or corrupt (none does); parses_as lists all
    grammars that take it, best rank first; likely is the first by tokens. Empty and comment-only java and js files are
    valid, empty xml and json files are not and count as corrupt, though the empty text is a script. Files with null
    path or content, and other extensions, don't come out. Rows delivered twice come out once; a key with different
    contents comes out once for each result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, accepted, likely = [], [], []
            for language, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                order = rank_languages(text)
                takes = [x for x in order if parses(x, text)]
                foreign = bool(takes) and bool(text.strip())
                status.append("valid" if language in takes else "wrong_extension" if foreign else "corrupt")
                accepted.append(takes)
                likely.append(order[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(status, pa.string()), pa.array(accepted, pa.list_(pa.string())), pa.array(likely, pa.string())],
                names=["repo_id", "path", "language", "status", "parses_as", "likely"],
            )

    judged = files.select("repo_id", "path", language_of(F.col("path")).alias("language"), "content").where("language is not null and content is not null")
    return judged.mapInArrow(judge, "repo_id string, path string, language string, status string, parses_as array<string>, likely string").distinct()


def parse_rates(judged: DataFrame) -> DataFrame:
    """Per repo_id and language: n_files, n_invalid, n_wrong_extension, n_corrupt, invalid_rate."""
    invalid = F.col("status") != "valid"
    return judged.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(invalid).alias("n_invalid"),
        F.count_if(F.col("status") == "wrong_extension").alias("n_wrong_extension"), F.count_if(F.col("status") == "corrupt").alias("n_corrupt"),
        F.avg(invalid.cast("double")).alias("invalid_rate"),
    )
