"""Matching entities across sources without keys, by loopy belief propagation.

The diff side and the graph side write the same method in different ways. Both writings are taken apart into package,
class, method and parameter types. Candidates agree in the class and nearly in the method: they share a spelling with
at most one letter left out. Each candidate pair gets log odds from its partial, noisy attributes; one-to-one factors
(a symbol means at most one method; a method is meant by one symbol of a patch, file and line, by more only with small
odds) then exchange messages with the pairs until they stand still, and give each pair its marginal probability.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakegraph.session import Workspace

UNDAMPED, DAMPED = 8, 40  # rounds after which messages move half way only, and less and less
HALVING = 20  # further rounds after which their step is halved again
STILL = 1e-4  # a step below which messages stand still
TWICE = 0.02  # what a place leaves to a further symbol: rows may name a method twice
THRESHOLD = 0.4
PREFIX = 4  # letters of a cut-off name that lead to its candidates

_COUNT = re.compile(r"^\s*(\d+)\s+args?\s*$")


def _split_types(text: str) -> list[str]:
    """Parts between the commas that stand outside of <>."""
    out, depth, part = [], 0, []
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth <= 0:
            out.append("".join(part))
            part = []
        else:
            part.append(ch)
    out.append("".join(part))
    return out


def _simple_type(text: str) -> str:
    """`final java.util.Map<String, Long> x` as `Map`."""
    plain, depth = [], 0
    for ch in text.strip():
        depth += ch == "<"
        if not depth:
            plain.append(ch)
        depth -= ch == ">"
    plain = re.sub(r"\s+(?=[\[.])", "", "".join(plain))
    plain = re.sub(r"@[\w.]+\s+", "", plain)
    words = [w for w in plain.split() if w != "final"]
    plain = words[0] if words else ""
    return plain.replace("...", "[]").rpartition(".")[2]


def read_name(text: str) -> tuple[list[str], str, str, str, list[str], int]:
    """(qualifiers, class, method, knowledge, types, count) of a written method.

    knowledge says what is known of the parameters: all (types), count, first (types up to where the text was cut off,
    the last one perhaps in part), none, or name when the text was cut off within the method's name. A constructor has
    the method <init>.
    """
    text = text.strip()
    cut = text.endswith("…") or (text.endswith("...") and "(" not in text)
    head, bracket, rest = text.partition("(")
    knowledge, types, count = "none", [], -1
    if bracket:
        if cut:
            knowledge, types = "first", [_simple_type(x) for x in _split_types(rest.rstrip("…. ")) ]
        else:
            inner = rest.rpartition(")")[0] if ")" in rest else rest
            m = _COUNT.match(inner)
            if m:
                knowledge, count = "count", int(m[1])
            elif inner.strip() in ("..", "...", "…", "?", "*"):
                pass
            else:
                types = [_simple_type(x) for x in _split_types(inner)] if inner.strip() else []
                knowledge, count = "all", len(types)
    elif cut:
        knowledge, head = "name", head.rstrip("….")
    parts = [p for p in re.split(r"::|[.#$/]", head) if p]
    method = parts.pop() if parts else ""
    owner = parts.pop() if parts else ""
    if method == owner and owner:
        method = "<init>"
    return parts, owner, method, knowledge, types, count


def plain(name: str) -> str:
    return name.replace("_", "").lower()


def letters_apart(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words; 3 stands for more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return min(3, last[-1])


def parts_apart(a: list[str], b: list[str]) -> float:
    """Edits between two lists of qualifiers; words that only differ by an ending count half."""
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            differs = 0.0 if x == y else 0.5 if x.startswith(y) or y.startswith(x) else 1.0
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + differs))
        last = row
    return last[-1]


def _path_parts(path: str | None) -> list[str]:
    return [p for p in re.split(r"[\\/]", path or "") if p][:-1]


def _ends_alike(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def log_odds(symbol, method, path: str | None, lines, spans) -> float | None:
    """Evidence for a pair, or None when an attribute rules it out. symbol and method are of read_name."""
    parts, owner, name, knowledge, types, count = symbol
    m_parts, m_owner, m_name, _, m_types, m_count = method
    score = -1.0  # against a match at all, for one in a class of this name
    a, b = plain(name), plain(m_name)
    if knowledge == "name":
        apart = 0 if b.startswith(a) else min(letters_apart(a, b[: len(a) + d]) for d in (-1, 0, 1)) if len(a) > 2 else 3
        if apart > 1:
            return None
        score += (3.0, 1.0)[apart]
    else:
        apart = letters_apart(a, b)
        if apart > 2 or apart == 2 and min(len(a), len(b)) < 4:
            return None
        score += (4.0, 1.5, -0.5 if len(a) > 8 else -1.5)[apart] + (0.5 if name == m_name else 0.0)
    alike = _ends_alike(parts, m_parts)
    if not parts or alike == len(parts) < len(m_parts):  # the package is lost, at most outer classes stand
        folders = _path_parts(path)
        nested = 1 if m_parts and m_parts[-1][:1].isupper() else 0
        package = m_parts[: len(m_parts) - nested]
        near = _ends_alike(folders, package)
        score += 1.0 if parts else 0.0
        if folders and package:
            score += 2.0 if near >= min(2, len(package)) else -0.5 if near else -3.0
    else:
        far = parts_apart(parts, m_parts)
        if far > 2:
            return None
        score += 3.0 - 2.0 * far
    if knowledge == "all":
        if count != m_count or types != m_types:
            return None
        score += 3.0
    elif knowledge == "count":
        if count != m_count:
            return None
        score += 1.5
    elif knowledge == "first":
        whole, partial = types[:-1], types[-1]
        if whole != m_types[: len(whole)]:
            return None
        if partial:
            follows = m_types[len(whole)] if len(m_types) > len(whole) else ""
            # what was cut off within a package or `final` names no type yet
            vague = partial.islower() and (follows[:1].isupper() or "final".startswith(partial))
            if not follows or not (follows.startswith(partial) or vague):
                return None
        score += 0.5 + 0.5 * len(whole)
    if lines[0] is not None and lines[1] is not None:
        best = -1.0
        for s, e in spans:
            if s is not None and e is not None:
                ds, de = abs(s - lines[0]), abs(e - lines[1])
                best = max(best, 4.0 if max(ds, de) <= 2 else 1.5 if abs(ds - de) <= 1 and (s < lines[0]) == (e < lines[1]) else -1.0)
        if spans:
            score += best
    return score


def spellings(name: Column) -> Column:
    """A name and all its spellings with one letter left out."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.when(name == "<init>", F.array(name)).otherwise(F.array_distinct(F.concat(F.array(name), without)))


def parsed(df: DataFrame, column: str) -> DataFrame:
    """df with owner, plain (name), knowledge, types (joined) and count of the written method in a column."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_name(x) for x in batch.column(at).to_pylist()]
            own = [[r[1] for r in read], [plain(r[2]) for r in read], [r[3] for r in read], [",".join(r[4]) for r in read]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x, pa.string()) for x in own], pa.array([r[5] for r in read], pa.int32())],
                names=[*batch.schema.names, "owner", "plain", "knowledge", "types", "count"],
            )

    return df.mapInArrow(work, f"{schema}, owner string, plain string, knowledge string, types string, count int")


def candidates(symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """(symbol_id, patch_id, file_path, start_line, method_fqn, score) of all pairs that no attribute rules out.

    Pairs have the class in common and a spelling of the name with at most one letter left out; where the symbol knows
    them, the types or their number too, so that a name that very many classes have falls into smaller blocks. Names
    cut off within the method meet by the spellings of their first letters. What is joined are hashes and row numbers;
    the score compares the names themselves.
    """
    space = Workspace(symbols.sparkSession)
    wanted = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR") & F.col("fqn").isNotNull()).select(
        "symbol_id", "patch_id", "fqn", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line")
    )
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    lines = F.struct(F.col("start_line").cast("int").alias("s"), F.col("end_line").cast("int").alias("e"))
    known = methods.where(F.col("fqn").isNotNull() & ~F.col("fqn").endswith("(?)")).groupBy(F.col("fqn").alias("method_fqn")).agg(
        F.collect_set(F.when(F.col("start_line").isNotNull(), lines)).alias("spans")
    )
    # numbers must not change when a task runs again, so they are written before use
    left = space.put(parsed(wanted, "fqn").withColumn("s", F.monotonically_increasing_id()))
    right = space.put(parsed(known, "method_fqn").join(left.select("owner").distinct(), "owner", "left_semi").withColumn("m", F.monotonically_increasing_id()))
    spelled = lambda *more: F.transform(spellings(F.col("plain")), lambda x: F.xxhash64(F.lit("name"), "owner", x, *more))
    first = F.substring("plain", 1, PREFIX)
    begun = lambda x: F.xxhash64(F.lit("begin"), "owner", x)
    know = F.col("knowledge")
    own = (
        F.when(know == "all", spelled(F.lit("types"), F.col("types"), F.col("count"))).when(know == "count", spelled(F.lit("count"), F.col("count")))
        .when(know == "name", F.when(F.length("plain") < PREFIX, F.array(begun(first))).otherwise(F.transform(spellings(first), begun))).otherwise(spelled())
    )
    told = F.concat(spelled(F.lit("types"), F.col("types"), F.col("count")), spelled(F.lit("count"), F.col("count")), spelled())
    cut = left.where(know == "name").select("owner").distinct()
    # a symbol's name may be cut off anywhere, even before its first letters are complete
    shorter = F.transform(F.sequence(F.lit(0), F.lit(PREFIX - 1)), lambda n: F.substring("plain", F.lit(1), n))
    heads = right.join(cut, "owner", "left_semi").select("m", F.explode(F.transform(F.array_distinct(F.concat(shorter, spellings(first))), begun)).alias("key"))
    keys = right.select("m", F.explode(told).alias("key")).unionByName(heads)
    met = left.select("s", F.explode(own).alias("key")).join(keys, "key").select("s", "m").distinct()
    pairs = met.join(left.select("s", *kinds), "s").join(right.select("m", "method_fqn", "spans"), "m").drop("s", "m").dropDuplicates(["symbol_id", "method_fqn"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple] = {}

        def read(text: str):
            if text not in parsed:
                if len(parsed) > 100_000:
                    parsed.clear()
                parsed[text] = read_name(text)
            return parsed[text]

        for batch in batches:
            got = []
            columns = [batch.column(n).to_pylist() for n in ("fqn", "method_fqn", "file_path", "start_line", "end_line", "spans")]
            for fqn, method, path, s, e, spans in zip(*columns):
                got.append(log_odds(read(fqn), read(method), path, (s, e), {(x["s"], x["e"]) for x in spans}))
            same = ["symbol_id", "patch_id", "file_path", "start_line", "method_fqn"]
            out = pa.RecordBatch.from_arrays([*map(batch.column, same), pa.array(got, pa.float64())], names=[*same, "score"])
            yield out.filter(pa.array([g is not None for g in got], pa.bool_()))

    return pairs.mapInArrow(score, f"symbol_id {kinds['symbol_id']}, patch_id {kinds['patch_id']}, file_path {kinds['file_path']}, start_line int, method_fqn string, score double")


def propagate(pairs: DataFrame) -> DataFrame:
    """pairs(symbol, place, score) with `belief`, the marginal probability that symbol and place belong together.

    A symbol belongs to at most one place, and a place to one symbol, to more with odds of TWICE. A pair sends each of
    its two factors what the other one leaves it; with w = exp(score) a factor's answer is 1 / (1 + the sum of
    w * message of its other pairs), for a place at least TWICE. Sums travel as aggregates, so a place wanted by very
    many symbols is no group in one task. Pairs are unique. Rounds go on until no message moves by STILL or more; ever
    smaller steps bring those to rest that would swing, which a warning then tells.
    """
    space = Workspace(pairs.sparkSession)
    state = space.put(pairs.withColumn("w", F.exp(F.least("score", F.lit(30.0)))).withColumn("from_place", F.lit(1.0)).withColumn("off", F.lit(0.0)))
    k = 0
    while True:
        step = 1.0 if k < UNDAMPED else 0.5 ** (1 + max(0, k - DAMPED) // HALVING)
        by_symbol = state.groupBy("symbol").agg(F.sum(F.col("w") * F.col("from_place")).alias("all_places"))
        told = state.join(by_symbol, "symbol").withColumn("from_symbol", 1 / (1 + F.greatest(F.col("all_places") - F.col("w") * F.col("from_place"), F.lit(0.0)))).drop("all_places")
        by_place = told.groupBy("place").agg(F.sum(F.col("w") * F.col("from_symbol")).alias("all_symbols"))
        answer = F.greatest(1 / (1 + F.greatest(F.col("all_symbols") - F.col("w") * F.col("from_symbol"), F.lit(0.0))), F.lit(TWICE))
        nxt = told.drop("off").join(by_place, "place").withColumn("off", F.abs(answer - F.col("from_place"))).withColumn("from_place", F.col("from_place") + step * (answer - F.col("from_place")))
        kept, seen = space.put_seen(nxt.select(*state.columns), moving=F.col("off") * step >= STILL, swinging=F.col("off") >= 100 * STILL)
        space.drop(state)
        state, k = kept, k + 1
        if not seen["moving"]:
            break
    if seen["swinging"]:
        warnings.warn(f"messages came to rest by damping only, after {k} rounds", stacklevel=2)
    by_symbol = state.groupBy("symbol").agg(F.sum(F.col("w") * F.col("from_place")).alias("all_places"))
    # the marginals of a symbol's pairs and of having none add up to 1
    return state.join(by_symbol, "symbol").withColumn("belief", F.col("w") * F.col("from_place") / (1 + F.col("all_places"))).select(*pairs.columns, "belief")


def match_symbols(symbols: DataFrame, methods: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(symbol_id, method_fqn, confidence) of every METHOD or CONSTRUCTOR symbol; null method and 0.0 for none.

    symbols: symbol_id, patch_id, fqn, kind, file_path, start_line, end_line; methods: fqn, start_line, end_line,
    other columns are ignored. A symbol's method is its most probable candidate if the probability is at least
    `threshold`, the least name among equals. A method is one place for each patch, file and starting line: rows that
    differ in one of them are no rivals for it. Rows with a null fqn have no method.
    """
    space = Workspace(symbols.sparkSession)
    found = candidates(symbols, methods)
    place = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("patch_id", "start_line", "file_path")], "method_fqn")
    pairs = space.put(found.select(F.col("symbol_id").alias("symbol"), place.alias("place"), "score", "method_fqn"))
    believed = propagate(pairs)
    best = believed.groupBy(F.col("symbol").alias("symbol_id")).agg(F.min_by(F.struct("method_fqn", "belief"), F.struct(-F.round("belief", 9), "method_fqn")).alias("m"))
    chosen = best.where(F.col("m.belief") >= threshold).select("symbol_id", F.col("m.method_fqn").alias("method_fqn"), F.col("m.belief").alias("confidence"))
    every = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).select("symbol_id").distinct()
    return every.join(chosen, "symbol_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
