"""Tagging of test cases: words of their texts that name something in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakegraph.functions import names

MIN_FRAGMENT = 4


def token_tags(tests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(test_id, kind, key, confidence): an identifier in the text equals the catalogue's word; greatest confidence.

    tests: test_id, text; catalogue: word, kind, key, confidence. Null texts and words tag nothing. A test's words are
    made distinct before the join, so a word costs one row a test.
    """
    words = tests.where("text is not null").select("test_id", F.explode(F.array_distinct(names.identifiers(F.col("text")))).alias("word"))
    return words.join(catalogue.where("word is not null").distinct(), "word").groupBy("test_id", "kind", "key").agg(F.max("confidence").alias("confidence"))


def url_tags(tests: DataFrame, urls: DataFrame, confidence: float = 0.6) -> DataFrame:
    """(test_id, kind, key, confidence): a URL's last part of at least MIN_FRAGMENT letters is a word of the text.

    urls: url. Parts are compared in lower case with the text's words, so parts that are no identifier, and hits inside
    longer words, are not found; url_substring_tags finds them.
    """
    parts = urls.select("url", F.lower(names.url_tail(F.col("url"))).alias("word")).where(F.length("word") >= MIN_FRAGMENT).distinct()
    words = tests.where("text is not null").select("test_id", F.explode(F.array_distinct(names.identifiers(F.lower("text")))).alias("word"))
    return words.join(parts, "word").select("test_id", F.lit("URL").alias("kind"), F.col("url").alias("key"), F.lit(confidence).alias("confidence")).distinct()


def _grams(text: Column) -> Column:
    """Distinct runs of MIN_FRAGMENT characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{MIN_FRAGMENT}}}))"), 1))


def url_substring_tags(tests: DataFrame, urls: DataFrame, confidence: float = 0.6) -> DataFrame:
    """(test_id, kind, key, confidence): the text has the URL, or its last part, anywhere; both of at least MIN_FRAGMENT characters.

    urls: url; `servlet:` doesn't belong to what is looked for. Compared in lower case. Whatever holds a fragment holds
    all its grams: of each fragment the gram that the fewest texts have leads to its candidates, which are then searched.
    """
    texts = tests.where("text is not null").select("test_id", F.lower("text").alias("text")).distinct()
    whole, tail = F.regexp_replace("url", "^servlet:", ""), names.url_tail(F.col("url"))
    parts = urls.where("url is not null").select("url", F.explode(F.array(F.lower(whole), F.lower(tail))).alias("fragment")).where(F.length("fragment") >= MIN_FRAGMENT).distinct()
    in_texts = texts.select("test_id", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = in_texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = parts.select("fragment").distinct().select("fragment", F.explode(_grams(F.col("fragment"))).alias("gram"))
    rarest = wanted.join(counts, "gram", "left").groupBy("fragment").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    likely = in_texts.join(rarest.select("fragment", F.col("r.gram").alias("gram")), "gram").select("test_id", "fragment")
    found = likely.join(texts, "test_id").where(F.contains("text", "fragment")).select("test_id", "fragment").distinct()
    return found.join(parts, "fragment").select("test_id", F.lit("URL").alias("kind"), F.col("url").alias("key"), F.lit(confidence).alias("confidence")).distinct()


def test_cases(documents: DataFrame) -> DataFrame:
    """Test cases, and the reports that name what they have covered."""
    return documents.where(F.col("doc_kind").isin("test_case", "impact_report")).select(F.col("doc_id").alias("test_id"), "text")


def covers_of(g) -> DataFrame:
    """Methods with source (start_line > 0) whose simple name is a word of a test case."""
    known = g.methods.where("start_line > 0").select(F.col("simple").alias("word"), F.lit("METHOD").alias("kind"), F.col("fqn").alias("key"), F.lit(0.8).alias("confidence"))
    return token_tags(test_cases(g.table("documents")), known)
