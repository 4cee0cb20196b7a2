"""Long exact spans shared between records, by compact windows.

A text is the sequence of its GRAM-character grams, each with a hash. A compact window (l, c, r) stands for all gram
sequences that begin at l or later, end at r or earlier and have their least hash at c (the leftmost of equals): these
are the nodes of the Cartesian tree of the hashes. Only those wide enough to hold a sequence of the wanted length are kept, cut to
what sequences of this length around c can reach. A stretch of text that stands in two records has its least gram at the same place in both, so both
have a window under this gram that covers the stretch; one hash function is enough for exact spans. Windows whose gram
occurs in one text only are done with. The others are grouped by gram: records with the same content of the window
share it whole, and where contents differ the sequences of the wanted length in it are compared by fingerprint, which
is the intersection of the windows' intervals and the verification in one aggregate. No pairs are formed. What a text
shares is kept as runs, at most a few a window, and merged by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.session import Workspace

MIN_LENGTH = 200
GRAM = 64  # characters; a power of two, less than the length of a span
SLICE = 1 << 20  # characters worked on at a time; longer texts are taken in overlapping pieces
_POSITION_BITS = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
FILTER_BITS = 27  # 16 MB broadcast at most
FILTER_LIMIT = 1 << 24  # shared grams up to which the filter is worth it; beyond, windows are joined


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all stretches of `gram` codes (a power of two), by doubling: of 2s codes from two of s."""
    h = _mix((codes.astype(np.uint64) + np.uint64(1)) * _M1)
    step, power = 1, _BASE
    while step < gram:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = step * 2, power * power % (1 << 64)
    return _mix(h)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours: running minima from the left and right within blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def compact_windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's windows of at least `width` hashes, cut to width - 1 on either side of c, by l.

    Order is by the upper bits of the hash and then by position. The windows are read off the sliding minima: c is the
    least of exactly those stretches of `width` that lie in [l, r].
    """
    if len(hashes) < width:
        none = np.empty(0, np.int64)
        return none, none, none
    low = np.uint64((1 << _POSITION_BITS) - 1)
    order = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    c = (_sliding_min(order, width) & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    last = np.append(first[1:], len(c)) - 1
    return first, c[first], last + width - 1


def _pieces(texts: list[str | None], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, offset, codes) of the texts of at least `length` characters; long ones in pieces that overlap by length - 1."""
    for i, text in enumerate(texts):
        if text is not None and len(text) >= length:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            for start in range(0, max(1, len(codes) - length + 1), SLICE):
                yield i, start, codes[start : start + SLICE + length - 1]


def _windows(texts: list[str | None], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, offset of the window in its text, c - l, number of characters, gram hash, codes) for groups of texts."""
    width = length - gram + 1
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def work():
        codes = np.concatenate([p[2] for p in held])
        lengths = np.array([len(p[2]) for p in held])
        ends = np.cumsum(lengths)
        hashes = gram_hashes(codes, gram)
        parts = []
        for (row, offset, own), end in zip(held, ends):
            start = end - len(own)
            l, c, r = compact_windows(hashes[start : end - gram + 1], width)
            parts.append((np.full(len(l), row), l + offset, c - l, r - l + gram, hashes[start + c], l + start))
        return [np.concatenate(x) for x in zip(*parts)], codes

    for piece in _pieces(texts, length):
        if size + len(piece[2]) > SLICE + length and held:
            yield work()
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield work()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _fingerprints(codes: np.ndarray, length: int) -> np.ndarray:
    """Two-word fingerprints of all stretches of `length` codes."""
    out = []
    for base, salt in ((_BASE, 1), (0x2545F4914F6CDD1D, 2)):
        h = _mix((codes.astype(np.uint64) + np.uint64(salt)) * _M1)
        # binary method: the hash of `length` codes from those of its powers of two
        total, done, step, power, p = None, 0, 1, base, h
        n = len(codes) - length + 1
        while step <= length:
            if length & step:
                part = p[done : done + n]
                total = part.copy() if total is None else total * np.uint64(power) + part
                done += step
            if step * 2 <= length:
                p = p[:-step] * np.uint64(power) + p[step:]
            step, power = step * 2, power * power % (1 << 64)
        out.append(_mix(total))
    return np.stack(out, axis=1)


def _pairs(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of a batch and place in its text as one number."""
    return (row.astype(np.int64) << 40) | at.astype(np.int64)


def _differ(a: str, b: str) -> Column:
    """Whether the least and the greatest class of a group are two: classes are told by two hashes, 128 bits."""
    return (F.col(f"{a}1") != F.col(f"{b}1")) | (F.col(f"{a}2") != F.col(f"{b}2"))


def _bounds(c: str, a: str, b: str) -> list[Column]:
    """Least and greatest of both hashes: numbers, so that groups are hashed and not sorted."""
    return [f(f"{c}{i}").alias(f"{n}{i}") for f, n in ((F.min, a), (F.max, b)) for i in (1, 2)]


SEEN = 1 << 17  # classes that a task remembers to have worked on


class SharedSpans:
    """Spans of at least `length` characters of texts(doc_id, text) that stand in another text; see found() and coverage().

    Null texts and those shorter than `length` have none; rows with equal doc_id are different records; characters are
    code points. Equal texts are one text for the work in between, told by 128 bits of two hashes (one of them over
    the MD5 sum); each of two or more records with an equal text of at least `length` characters shares all of it.
    """

    def __init__(self, documents: DataFrame, length: int = MIN_LENGTH, gram: int = GRAM, filter_limit: int = FILTER_LIMIT):
        if gram & (gram - 1) or gram > length:
            raise ValueError("gram must be a power of two and at most length")
        self.spark, self.length, self.gram = documents.sparkSession, length, gram
        self.space = Workspace(self.spark)
        long_enough = documents.select("doc_id", "text").where(F.length("text") >= length)
        self.texts = long_enough.select("doc_id", "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.md5("text")).alias("c2"))
        self.kind = documents.schema["doc_id"].dataType.simpleString()
        self.filter_limit = filter_limit

    def shared_grams(self) -> DataFrame:
        """(gram) of the compact windows that different texts have."""
        length, gram = self.length, self.gram

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for batch in batches:
                batch = _unseen(batch, seen)
                c1, c2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for (row, _, _, _, h, _), _ in _windows(batch.column(2).to_pylist(), length, gram):
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(c1[row]), pa.array(c2[row])], names=["gram", "c1", "c2"])

        found = self.texts.select("c1", "c2", "text").mapInArrow(windows, "gram long, c1 long, c2 long")
        return found.groupBy("gram").agg(*_bounds("c", "a", "b")).where(_differ("a", "b")).select("gram")

    def contexts(self) -> DataFrame:
        """c1, c2, gram, at (of the window in the text), place (of the gram in the window), content: the windows whose
        gram other texts have, of each different text (of some twice)."""
        space = self.space
        grams = space.put(self.shared_grams())
        length, gram = self.length, self.gram
        schema = "c1 long, c2 long, gram long, at long, place int, content string"
        names = ["c1", "c2", "gram", "at", "place", "content"]
        few = grams.count() <= self.filter_limit
        known = self.spark.sparkContext.broadcast(self._filter(grams)) if few else None

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, seen = np.uint64((1 << FILTER_BITS) - 1), set()
            for batch in batches:
                batch = _unseen(batch, seen)
                if known is None:
                    listed = batch.column(3)
                    owner = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
                    wanted = _pairs(owner, listed.flatten().to_numpy())
                for (row, at, place, size, h, begin), codes in _windows(batch.column(2).to_pylist(), length, gram):
                    if known is None:
                        keep = np.flatnonzero(np.isin(_pairs(row, at), wanted))
                    else:
                        slot = h & low
                        keep = np.flatnonzero(known.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    for s in range(0, len(keep), 4096):
                        k = keep[s : s + 4096]
                        content = [codes[b : b + w].tobytes().decode("utf-32-le") for b, w in zip(begin[k].tolist(), size[k].tolist())]
                        own = pa.array(row[k])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(own), batch.column(1).take(own), _signed(h[k]), pa.array(at[k]), pa.array(place[k].astype(np.int32)), pa.array(content, pa.string())],
                            names=names,
                        )

        if few:
            found = self.texts.select("c1", "c2", "text").mapInArrow(cut, schema).join(grams, "gram", "left_semi")
        else:

            def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                seen: set = set()
                for batch in batches:
                    batch = _unseen(batch, seen)
                    c1, c2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    for (row, at, _, _, h, _), _ in _windows(batch.column(2).to_pylist(), length, gram):
                        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(c1[row]), pa.array(c2[row]), pa.array(at)], names=["gram", "c1", "c2", "at"])

            # the places of a text: no more than it has windows
            listed = (
                self.texts.select("c1", "c2", "text").mapInArrow(places, "gram long, c1 long, c2 long, at long").join(grams, "gram", "left_semi")
                .groupBy("c1", "c2").agg(F.collect_set("at").alias("places"))
            )
            # copies of a text are brought down to one before the join
            once = self.texts.groupBy("c1", "c2").agg(F.first("text").alias("text"))
            found = once.join(listed, ["c1", "c2"]).select("c1", "c2", "text", "places").mapInArrow(cut, schema).join(grams, "gram", "left_semi")
        return space.put(found.select(*names))

    def _filter(self, grams: DataFrame) -> np.ndarray:
        slot = F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1)
        parts = grams.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << 15) - 1)).alias("bits"))
        out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for row in parts.toLocalIterator():  # at most 2**(FILTER_BITS - 15) rows of 4 KB
            out[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
        return out

    def _keys(self) -> tuple[DataFrame, DataFrame]:
        """doc_id, c1, c2, n_chars of the records, and c1, c2 of the texts that several records have."""
        keys = self.space.put(self.texts.select("doc_id", "c1", "c2", F.length("text").cast("long").alias("n_chars")))
        return keys, keys.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")

    def _alike(self) -> tuple[DataFrame, DataFrame]:
        """placed: c1, c2, at, gram, cid of every window; contents: cid, gram, a1, a2 (a text that has it), many (others
        have it too), content. Contents are told by 128 bits of two hashes."""
        told = [F.xxhash64("place", "content").alias("s1"), F.xxhash64("place", F.md5("content")).alias("s2")]
        contexts = self.contexts().select("*", *told)
        contents = contexts.groupBy("s1", "s2").agg(F.min("gram").alias("gram"), *_bounds("c", "a", "b"), F.first("content").alias("content"))
        # written before use: ids do not change when a task runs again
        contents = self.space.put(contents.select("s1", "s2", F.monotonically_increasing_id().alias("cid"), "gram", "a1", "a2", _differ("a", "b").alias("many"), "content"))
        placed = self.space.put(contexts.select("c1", "c2", "at", "s1", "s2").distinct().join(contents.select("s1", "s2", "cid", "gram", "many"), ["s1", "s2"]).drop("s1", "s2"))
        return placed, contents.drop("s1", "s2")

    def _common(self, contents: DataFrame) -> DataFrame:
        """(cid, start) of the stretches of `length` characters that a content of one text has and another text too."""
        length = self.length

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(4).to_pylist()
                own = [batch.column(i) for i in range(4)]
                for s in range(0, len(texts), 2000):
                    group = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts[s : s + 2000]]
                    sizes = np.array([len(g) for g in group])
                    prints = _fingerprints(np.concatenate(group), length)
                    begins = np.cumsum(sizes) - sizes
                    counts = sizes - length + 1
                    row = np.repeat(np.arange(len(group)), counts)
                    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    p = prints[begins[row] + start]
                    at = pa.array(s + row)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.ascontiguousarray(p[:, 0])), _signed(np.ascontiguousarray(p[:, 1])), *[c.take(at) for c in own], pa.array(start.astype(np.int32))],
                        names=["f1", "f2", "cid", "k1", "k2", "many", "start"],
                    )

        # only grams with different contents, one of which is of one text only, have something to compare
        groups = contents.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("many")).alias("open")).where("n > 1 and open > 0").select("gram")
        compared = contents.join(groups, "gram", "left_semi").select("cid", F.col("a1").alias("k1"), F.col("a2").alias("k2"), "many", "content")
        prints = compared.mapInArrow(expand, "f1 long, f2 long, cid long, k1 long, k2 long, many boolean, start int")
        shared = prints.groupBy("f1", "f2").agg(*_bounds("k", "a", "b"), F.max("many").alias("many")).where(F.col("many") | _differ("a", "b")).select("f1", "f2")
        return prints.where(~F.col("many")).select("f1", "f2", "cid", "start").join(shared, ["f1", "f2"], "left_semi").select("cid", "start")

    def found(self) -> DataFrame:
        """Distinct doc_id of the records that share a span."""
        keys, equal = self._keys()
        placed, contents = self._alike()
        certain = self.space.put(placed.where("many").select("c1", "c2").union(equal).distinct())
        # groups of a gram with a text not found yet are compared stretch by stretch
        open_grams = placed.join(certain, ["c1", "c2"], "left_anti").select("gram").distinct()
        hit = self._common(contents.join(open_grams, "gram", "left_semi")).select("cid").distinct()
        classes = certain.unionByName(placed.join(hit, "cid", "left_semi").select("c1", "c2")).distinct()
        return keys.join(classes, ["c1", "c2"], "left_semi").select("doc_id").distinct()

    def coverage(self) -> DataFrame:
        """doc_id, n_chars, n_spans, shared_chars, shared_part of every record with text of at least `length`
        characters: the maximal stretches made of shared spans, and what part of the text they cover."""
        keys, equal = self._keys()
        placed, contents = self._alike()
        length = self.length

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Starts of a content, in order, to the runs they cover: a start within the last run's reach goes on with it."""
            for batch in batches:
                starts = batch.column(1)
                values = starts.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
                first = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] > values[:-1] + length))[: len(values)]
                last = np.append(first[1:], True)[: len(values)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[first])), pa.array(values[first]), pa.array(values[last] + length)], names=["cid", "low", "high"]
                )

        # a content is no longer than two spans, so it has no more starts than one
        some = self._common(contents).groupBy("cid").agg(F.array_sort(F.collect_set("start")).alias("starts")).mapInArrow(runs, "cid long, low long, high long")
        whole = contents.where("many").select("cid", F.lit(0).cast("long").alias("low"), F.length("content").cast("long").alias("high"))
        parts = some.unionByName(whole)
        own = placed.join(equal, ["c1", "c2"], "left_anti").select("c1", "c2", "at", "cid")
        spans = own.join(parts, "cid").select("c1", "c2", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
        before = F.max("high").over(Window.partitionBy("c1", "c2").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
        merged = spans.withColumn("before", before).groupBy("c1", "c2").agg(
            F.count_if(F.col("before").isNull() | (F.col("low") > F.col("before"))).cast("int").alias("n_spans"),
            F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce("before", "low")))).cast("long").alias("shared_chars"),
        )
        shares = merged.unionByName(equal.select("c1", "c2", F.lit(1).alias("n_spans"), F.lit(None).cast("long").alias("shared_chars")))
        rows = keys.join(shares, ["c1", "c2"], "left")
        chars = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("shared_chars", "n_chars")).cast("long")
        return rows.select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), chars.alias("shared_chars"), (chars / F.col("n_chars")).alias("shared_part"))


def _unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows of texts that this task has not worked on, as far as it remembers; the first two columns tell a text."""
    keep = []
    for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        keep.append(key not in seen)
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(key)
    return batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))
