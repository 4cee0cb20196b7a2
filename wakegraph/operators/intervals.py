"""Line intervals: hunks and symbols of a file.

Intervals are joined over the file and the bins of BIN lines that both touch, so that one very long file isn't one
group of all pairs; a pair that meets in several bins is counted in the first they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 256


def overlapping(hunks: DataFrame, symbols: DataFrame, on: str = "file_path") -> DataFrame:
    """All columns of hunks (h_start, h_end) and symbols (s_start, s_end) of one file that overlap.

    Rows with a null file or bound, and intervals that end before they start, meet nothing. Other equal column names
    must be renamed before.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))
    h = hunks.where("h_start <= h_end").withColumn("__bin", F.explode(span("h_start", "h_end")))
    s = symbols.where("s_start <= s_end").withColumn("__bin", F.explode(span("s_start", "s_end")))
    first = F.floor(F.greatest("h_start", "s_start") / BIN)
    return h.join(s, [on, "__bin"]).where("h_start <= s_end and s_start <= h_end").where(F.col("__bin") == first).drop("__bin")


def smallest_enclosing(hunks: DataFrame, symbols: DataFrame, hunk_key: str, symbol_key: str, on: str = "file_path") -> DataFrame:
    """(hunk_key, symbol_key) of the smallest symbol around each hunk; the first by start and name among equals."""
    pairs = overlapping(hunks, symbols, on).where("s_start <= h_start and h_end <= s_end")
    size = F.struct(F.col("s_end") - F.col("s_start"), "s_start", symbol_key)
    return pairs.groupBy(hunk_key).agg(F.min_by(symbol_key, size).alias(symbol_key))


def inside(hunks: DataFrame, symbols: DataFrame, hunk_key: str, symbol_key: str, on: str = "file_path") -> DataFrame:
    """(hunk_key, symbol_key) of the symbols that lie within each hunk."""
    return overlapping(hunks, symbols, on).where("h_start <= s_start and s_end <= h_end").select(hunk_key, symbol_key).distinct()


def touched_symbols(hunks: DataFrame, symbols: DataFrame, hunk_key: str, symbol_key: str, on: str = "file_path") -> DataFrame:
    """(hunk_key, symbol_key, rule): symbols inside the hunk, else the smallest around it, else all that it overlaps."""
    pairs = overlapping(hunks, symbols, on)
    rule = F.when((F.col("h_start") <= F.col("s_start")) & (F.col("s_end") <= F.col("h_end")), 1).when((F.col("s_start") <= F.col("h_start")) & (F.col("h_end") <= F.col("s_end")), 2).otherwise(3)
    ruled = pairs.withColumn("rule", rule)
    best = Window.partitionBy(hunk_key)
    order = Window.partitionBy(hunk_key, "rule").orderBy(F.col("s_end") - F.col("s_start"), "s_start", symbol_key)
    kept = ruled.withColumn("__best", F.min("rule").over(best)).where("rule = __best").withColumn("__n", F.row_number().over(order))
    return kept.where("rule <> 2 or __n = 1").select(hunk_key, symbol_key, "rule").distinct()


SEARCHED = 50  # lines around its place in which a hunk is looked for at least


def matched_contents(edits: DataFrame, contents: DataFrame, on: str = "file_path") -> DataFrame:
    """(edit_id, hunk_id): the hunk content that an edited range belongs to.

    edits: edit_id, file_path, h_start; contents: hunk_id, file_path, b_start, n_lines (on the new side). A content
    that begins at the range's first line comes before one that only has it among its lines; the first by hunk_id among
    equals. Ranges that no content has don't come out.
    """
    points = edits.select("edit_id", on, "h_start", F.col("h_start").alias("h_end"))
    lines = contents.select("hunk_id", on, "b_start", F.col("b_start").alias("s_start"), (F.col("b_start") + F.greatest("n_lines", F.lit(1)) - 1).alias("s_end"))
    met = overlapping(points, lines, on).withColumn("rank", F.struct(F.col("h_start") != F.col("b_start"), "hunk_id"))
    return met.groupBy("edit_id").agg(F.min_by("hunk_id", "rank").alias("hunk_id"))


def anchored_shift(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(hunk_id, shift): how far a hunk has moved, from where its anchor lines now stand.

    lines: file_path, line_no, text; anchors: hunk_id, file_path, b_start, kind (1 trailing context, 2 leading context,
    3 added lines), expected (line), text. Texts are compared without surrounding blanks. All anchors of a kind must
    stand at one common shift; kinds are tried in order. Of several places the one counts whose first anchor is nearest
    to b_start, the one further up among equals; places further away than the file reaches on the other side, and than
    SEARCHED lines, are not looked at. Hunks without a hit don't come out.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    a = anchors.where("text is not null").select("hunk_id", "file_path", "b_start", "kind", "expected", bare("text").alias("text"))
    wanted = a.groupBy("hunk_id", "kind", "b_start").agg(F.count(F.lit(1)).alias("n_wanted"), F.min("expected").alias("first"))
    text = lines.select("file_path", bare("text").alias("text"), "line_no")
    sizes = lines.groupBy("file_path").agg(F.max("line_no").alias("n_lines"))
    found = (
        a.drop("b_start").join(text, ["file_path", "text"]).withColumn("shift", F.col("line_no") - F.col("expected"))
        .groupBy("hunk_id", "file_path", "kind", "shift").agg(F.count(F.lit(1)).alias("n_found"))
    )
    place = F.col("first") + F.col("shift")
    radius = F.greatest(F.lit(SEARCHED), F.abs(F.col("n_lines") - (F.col("b_start") - 1)))
    hits = found.join(wanted, ["hunk_id", "kind"]).where("n_found = n_wanted").join(sizes, "file_path")
    hits = hits.where((place >= F.col("b_start") - radius) & (place < F.col("b_start") + radius))
    return hits.groupBy("hunk_id").agg(F.min_by("shift", F.struct("kind", F.abs(place - F.col("b_start")), place)).alias("shift"))


def reconciled(edits: DataFrame, contents: DataFrame, anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """edits (edit_id, file_path, h_start, h_end) with new_start, new_end: moved by the shift of their content.

    What is moved is cut to the file's lines; edits without a content, without a hit or of a file without lines stay.
    """
    sizes = lines.groupBy("file_path").agg(F.max("line_no").alias("n_lines"))
    moved = matched_contents(edits, contents).join(anchored_shift(lines, anchors), "hunk_id").select("edit_id", "shift")
    rows = edits.join(moved, "edit_id", "left").join(sizes, "file_path", "left").withColumn("by", F.when(F.col("n_lines").isNotNull(), F.col("shift")))
    start = F.greatest(F.col("h_start") + F.col("by"), F.lit(1))
    end = F.least(F.greatest(F.col("h_end") + F.col("by"), start), F.col("n_lines"))
    still = F.coalesce("by", F.lit(0)) == 0
    return rows.select(*edits.columns, F.when(still, F.col("h_start")).otherwise(start).alias("new_start"), F.when(still, F.col("h_end")).otherwise(end).alias("new_end"))


def merge_duplicate_symbols(symbols: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """One row per (file_path, fqn, kind): least start, greatest end, the nature of highest rank, lines of the first row.

    symbols: symbol_id (the order), file_path, fqn, kind, start_line, end_line, nature, hunk_start_line, hunk_end_line.
    Null keys are values of their own.
    """
    from wakegraph.functions.names import name_of_rank, rank

    return symbols.groupBy("file_path", "fqn", "kind").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        name_of_rank(F.max(rank(F.col("nature"), ranks)), ranks).alias("nature"),
        F.min_by("hunk_start_line", "symbol_id").alias("hunk_start_line"), F.min_by("hunk_end_line", "symbol_id").alias("hunk_end_line"),
        F.count(F.lit(1)).alias("n_rows"),
    )
