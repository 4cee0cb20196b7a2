"""Encoding of a corpus with a public byte-level BPE tokenizer by content-defined chunk reuse.

A rolling hash over the bytes of each text proposes cuts, so that equal stretches of different documents fall into
equal chunks wherever they stand. Texts are cut once into a table of chunk hashes; a chunk that occurs more than once
is encoded once, in one of its texts, and joined back to the others. Texts without such a chunk are encoded where they
are read. The tokenizer splits a text by a pattern before it merges bytes, and the pattern always splits
between a visible character and the white space after it, so a cut there is exact. A cut elsewhere may have torn a
token: such joins are repaired by encoding anew from the last exact place before the cut to the first one after it,
whose token boundaries agree with those of the chunks by construction.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakegraph.session import Workspace

DEFAULT_TOKENIZER = "byte_bpe_50k"
MEAN_CHUNK = 512  # bytes between proposed cuts, on average; a power of two
WINDOW = 32  # bytes that the rolling hash covers
SLICE = 1 << 20  # bytes hashed at a time

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True


def _gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = _gear()


@functools.lru_cache(maxsize=4)
def encoding(name: str = DEFAULT_TOKENIZER, folder: str | None = None):
    """The tiktoken encoding of a .tiktoken file of the public tokenizers (or of `folder`)."""
    import public_tokenizers
    import tiktoken

    path = f"{folder}/{name}.tiktoken" if folder else public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rolling_cuts(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Positions after which the hash of the last WINDOW bytes ends in zeros; they depend on those bytes alone."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # the hash of 2s bytes from two of s bytes
        h = (h[:-step] << np.uint32(step)) + h[step:]
        step *= 2
    mask = np.uint32((mean - 1) << (33 - mean.bit_length()))  # the upper bits, which depend on most of the window
    return np.flatnonzero((h & mask) == 0) + WINDOW


def cut_texts(texts: list[bytes], mean: int = MEAN_CHUNK) -> Iterator[tuple[list[int], list[bool]]]:
    """Of each UTF-8 text the ends of its chunks, and whether each end is exact.

    A proposed cut moves on to the next exact place before the following proposal, and stays where it is (at a
    character's start) if there is none. Texts are worked on together, but a text's cuts depend on its own bytes alone.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield from _cut_group(held, mean)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from _cut_group(held, mean)


def _cut_group(texts: list[bytes], mean: int) -> Iterator[tuple[list[int], list[bool]]]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.append(0, ends[:-1])
    cuts = [rolling_cuts(raw[s : s + SLICE + WINDOW - 1], mean) + s for s in range(0, len(raw), SLICE)]
    cuts = np.unique(np.concatenate(cuts)) if cuts else np.empty(0, np.int64)
    owner = np.searchsorted(ends, cuts, "right")
    own = owner < len(texts)
    cuts, owner = cuts[own], owner[own]
    own = cuts - starts[owner] >= WINDOW  # the hashed bytes are all of this text
    cuts, owner = cuts[own], owner[own]
    limit = np.minimum(np.append(cuts[1:], len(raw)), ends[owner])
    places = np.append(np.flatnonzero(_VISIBLE[raw[:-1]] & _BLANK[raw[1:]]) + 1, len(raw))
    moved = places[np.searchsorted(places, cuts)]
    exact = moved < limit
    moved = np.where(exact, moved, cuts)
    for i in np.flatnonzero(~exact):  # rare: no white space between two proposals
        while moved[i] < ends[owner[i]] and raw[moved[i]] & 0xC0 == 0x80:
            moved[i] += 1
    keep = np.append(moved[1:] != moved[:-1], True) & (moved < ends[owner])
    moved, exact, owner = moved[keep], exact[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    inner, sure = (moved - starts[owner]).tolist(), exact.tolist()
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        yield [*inner[a:b], len(text)], [*sure[a:b], True]


def exact_places(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.flatnonzero(_VISIBLE[raw[:-1]] & _BLANK[raw[1:]]) + 1 if len(raw) > 1 else np.empty(0, np.int64)


def join_chunks(enc, chunks: list[bytes], exact: list[bool], ids: list[np.ndarray]) -> np.ndarray:
    """The ids of the whole text from those of its chunks, repairing the joins that aren't exact."""
    if all(exact):
        return np.concatenate(ids) if len(ids) > 1 else ids[0]
    out: list[np.ndarray] = []
    i = 0
    while i < len(chunks):
        j = i
        while not exact[j]:
            j += 1
        if i == j:
            out.append(ids[i])
        else:  # chunks i..j hang together
            head, tail = exact_places(chunks[i]), exact_places(chunks[j])
            lengths = lambda x: np.cumsum([len(enc.decode_single_token_bytes(int(t))) for t in x])
            if len(head):
                n = int(np.searchsorted(lengths(ids[i]), head[-1])) + 1
                out.append(ids[i][:n])
                first = chunks[i][head[-1] :]
            else:
                first = chunks[i]
            last, rest = chunks[j], None
            if len(tail):
                n = int(np.searchsorted(lengths(ids[j]), tail[0])) + 1
                last, rest = chunks[j][: tail[0]], ids[j][n:]
            middle = b"".join([first, *chunks[i + 1 : j], last])
            out.append(np.array(enc.encode_ordinary(middle.decode()), np.int32))
            if rest is not None:
                out.append(rest)
        i = j + 1
    return np.concatenate(out)


def _encode(enc, chunk: bytes) -> np.ndarray:
    """Ids of a chunk. A chunk is valid UTF-8, as cuts stand at character starts."""
    return np.array(enc.encode_ordinary(chunk.decode()), np.int32)


def chunked(texts: list[bytes], mean: int) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Of each text its chunks and whether each ends at an exact place."""
    for text, (ends, exact) in zip(texts, cut_texts(texts, mean)):
        yield [text[a:b] for a, b in zip([0, *ends[:-1]], ends)], exact


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def chunk_hashes(rows: DataFrame, mean: int = MEAN_CHUNK) -> DataFrame:
    """(row, hash) of every chunk of rows(row, text), as often as it occurs."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            counts = []
            for chunks, _ in chunked(_texts(batch, 1), mean):
                found.extend(map(xxhash.xxh3_128_digest, chunks))
                counts.append(len(chunks))
            own = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.binary())], names=["row", "hash"])

    return rows.select("row", "text").mapInArrow(hashes, "row long, hash binary")


def _rows(documents: DataFrame) -> DataFrame:
    """The documents with something to encode; equal rows share a `row`, as their chunks are the same."""
    return documents.select("doc_id", "text").where("text is not null and text <> ''").withColumn("row", F.xxhash64("doc_id", "text"))


def shared_chunks(documents: DataFrame, mean: int = MEAN_CHUNK) -> DataFrame:
    """(hash, home) of the chunks that occur more than once, within a text or across texts, with one row that has it."""
    return _shared(chunk_hashes(_rows(documents), mean))


def _shared(found: DataFrame) -> DataFrame:
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("home")).where("n > 1").select("hash", "home")


FILTER_BITS = 26  # 8 MB: the size of what is broadcast, whatever the corpus


def shared_filter(shared: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits in which those of the given hashes are set: fixed size, no hash is missed."""
    slot = F.conv(F.substring(F.hex("hash"), 1, 16), 16, 10).cast("decimal(20,0)")
    slot = F.pmod(slot, F.lit(1 << FILTER_BITS)).cast("long")
    parts = shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << 15) - 1)).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():  # at most 2**(FILTER_BITS - 15) rows of 4 KB
        out[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def _in_filter(bits: np.ndarray, digest: bytes) -> bool:
    slot = int.from_bytes(digest[:8], "big") & ((1 << FILTER_BITS) - 1)
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def _rows_in_filter(bits: np.ndarray, rows: pa.Array) -> np.ndarray:
    slot = rows.to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def encode_documents(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None, mean: int = MEAN_CHUNK) -> DataFrame:
    """(doc_id, ids) of every row of documents(doc_id, text); other columns are ignored.

    Null and empty texts give an empty list; special tokens' strings are ordinary text. Rows with equal or null doc_id
    stay apart. The ids equal those of encoding each text in one piece.

    A bitmap of fixed size tells which texts may have a shared chunk; the fuller it is, the more texts take the way of
    those that do, which is right for every text and only costs a shuffle of it.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    full = _rows(documents)
    kind = full.schema["doc_id"].dataType.simpleString()
    found = space.put(chunk_hashes(full, mean))
    wanted = space.put(found.join(_shared(found), "hash").distinct())
    space.drop(found)
    row_hash = F.unhex(F.lpad(F.hex("row"), 16, "0")).alias("hash")
    sharing = spark.sparkContext.broadcast(shared_filter(wanted.select("row").distinct().select(row_hash)))

    def encode_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for batch in batches:
            batch = batch.filter(pa.array(~_rows_in_filter(sharing.value, batch.column(0))))
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield _id_lists(part.column(1), [np.array(enc.encode_ordinary(t), np.int32) for t in part.column(2).to_pylist()])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_rows_in_filter(sharing.value, batch.column(0))))

    # texts that may have a shared chunk, read once more for its encoding and once for their own
    texts = space.put(full.select("row", "doc_id", "text").mapInArrow(pick, f"row long, doc_id {kind}, text string"))

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for batch in batches:
            hashes, ids = [], []
            for (chunks, _), own in zip(chunked(_texts(batch, 0), mean), batch.column(1).to_pylist()):
                left = set(own)
                for chunk in chunks:
                    if (h := xxhash.xxh3_128_digest(chunk)) in left:
                        left.discard(h)
                        hashes.append(h)
                        ids.append(_pack(_encode(enc, chunk)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["hash", "ids"])

    # a text's chunks: no more than the text has
    homes = wanted.select(F.col("home").alias("row"), "hash").distinct().groupBy("row").agg(F.collect_list("hash").alias("own"))
    dictionary = space.put(texts.join(homes, "row").select("text", "own").mapInArrow(encode_once, "hash binary, ids binary").dropDuplicates(["hash"]))
    brought = wanted.join(dictionary, "hash").groupBy("row").agg(F.collect_list(F.struct("hash", "ids")).alias("given"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for batch in batches:
            texts, given = _texts(batch, 1), batch.column(2)
            for start in range(0, batch.num_rows, 1000):
                out = []
                for i, (chunks, exact) in enumerate(chunked(texts[start : start + 1000], mean), start):
                    have = {g["hash"]: g["ids"] for g in given[i].as_py() or ()}
                    out.append(join_chunks(enc, chunks, exact, _chunk_ids(enc, chunks, exact, have)))
                yield _id_lists(batch.column(0).slice(start, 1000), out)

    result = f"doc_id {kind}, ids array<int>"
    plain = full.select("row", "doc_id", "text").mapInArrow(encode_plain, result)
    joined = texts.join(brought, "row", "left").select("doc_id", "text", "given").mapInArrow(assemble, result)
    empty = documents.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return plain.unionByName(joined).unionByName(empty)


def _id_lists(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; the first byte tells."""
    return b"\2" + ids.astype(np.uint16).tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data[0] == 2 else np.int32, offset=1).astype(np.int32)


def _chunk_ids(enc, chunks: list[bytes], exact: list[bool], have: dict[bytes, bytes]) -> list[np.ndarray]:
    """Ids of each chunk: those given, and the neighbouring others encoded together up to exact joins."""
    if not have:
        if all(exact):
            ids = _encode(enc, b"".join(chunks))
            return [ids, *[ids[:0]] * (len(chunks) - 1)]
        return [_encode(enc, c) for c in chunks]
    out: list[np.ndarray] = []
    run: list[bytes] = []

    def flush() -> None:
        if run:
            ids = _encode(enc, b"".join(run))
            out.extend([ids, *[ids[:0]] * (len(run) - 1)])
            run.clear()

    whole = all(exact)
    for chunk in chunks:
        packed = have.get(xxhash.xxh3_128_digest(chunk))
        if packed is None and whole:
            run.append(chunk)
        else:
            flush()
            out.append(_unpack(packed) if packed is not None else _encode(enc, chunk))
    flush()
    return out


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """documents(doc_id, text, source) with n_tokens in place of the text; 0 for null and empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(count, f"doc_id {kind}, source string, n_tokens long")
