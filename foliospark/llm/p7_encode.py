"""Token ids of every document by a public byte-level BPE vocabulary, with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes has a given remainder, so equal passages give
equal chunks wherever they stand; a chunk is encoded once per worker and found again in a bounded
cache. A cut in front of a blank between two letters is a boundary of the tokenizer's own splitting
and needs no repair; behind any other cut the surroundings are encoded again, over a growing window,
until the ids agree with those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.tables import table

#: Chunks that a worker keeps; beyond that its cache is emptied. Changes speed and memory, never ids.
CACHE_CHUNKS = 250_000
#: Mean distance of cuts: one in so many blanks between letters; one in so many other characters.
EVERY_BLANK, EVERY_OTHER = 64, 1024
#: Bytes of text that are worked on at once.
SLICE_BYTES = 4 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary file of this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def _gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For every byte a hash of the 16 bytes that end there."""
    h = _gear()[data]
    for step in (1, 2, 4, 8):
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h = g
    return h


class Encoder:
    """Encodes texts by reuse of chunks; equal to encoding each whole text."""

    def __init__(self, path: str, every_blank: int = EVERY_BLANK, every_other: int = EVERY_OTHER, cache: int = CACHE_CHUNKS):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = regex.compile(public_tokenizers.PATTERN)
        self._size = {v: len(k) for k, v in ranks.items()}
        self._known: dict[bytes, bytes] = {}
        self._cache, self._blank, self._other = cache, every_blank, every_other
        self.encoded = self.reused = 0

    def whole(self, text: str) -> list[int]:
        return self._bpe.encode_ordinary(text)

    def _chunk(self, data: bytes) -> bytes:
        ids = self._known.get(data)
        if ids is None:
            if len(self._known) >= self._cache:
                self._known.clear()
            ids = self._known[data] = array("i", self._bpe.encode_ordinary(data.decode())).tobytes()
            self.encoded += 1
        else:
            self.reused += 1
        return ids

    def cuts(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, safe): where chunks begin; text starts and cuts in front of a blank between letters are safe."""
        a = np.frombuffer(data, np.uint8)
        h = rolling_hash(a)
        safe = np.zeros(len(a), bool)
        safe[1:-1] = (a[1:-1] == 32) & _LETTER[a[:-2]] & _LETTER[a[2:]] & (h[1:-1] >> 16 & np.uint32(0xFFFF) < 65536 // self._blank)
        other = (a >= 0xC0) & (h >> 16 & np.uint32(0xFFFF) < 65536 // self._other)
        begin = starts[starts < len(a)]
        safe[begin] = True
        at = np.flatnonzero(safe | other)
        return at, safe[at]

    def _bytes_to_ids(self, ids: bytes, size: int) -> int:
        """Into ``ids``, in bytes, behind the tokens that make up the first ``size`` bytes of text."""
        n = i = 0
        tokens = memoryview(ids).cast("i")
        while n < size:
            n += self._size[tokens[i]]
            i += 1
        assert n == size, "a boundary inside a token"
        return 4 * i

    def _repaired(self, chunks: list[bytes]) -> bytes:
        """The ids of chunks that were cut anywhere."""
        out: list[bytes] = []
        left, ids = chunks[0].decode(), self._chunk(chunks[0])  # starts at a true boundary
        for data in chunks[1:]:
            right, right_ids = data.decode(), self._chunk(data)
            ends = [m.end() for m in self._piece.finditer(left)]
            keep = ends[-3] if len(ends) > 2 else 0  # pieces further left can't depend on what follows
            own = None
            width = 32
            while True:
                whole = width >= len(right)
                window = left[keep:] + right[:width]
                join = len(left) - keep
                own = {m.end() for m in self._piece.finditer(right[:width])} if own is None or width > 32 else own
                limit = len(window) if whole else len(window) - 8
                meet = next((e for m in self._piece.finditer(window) if (e := m.end()) >= join and e < limit and e - join in own and (whole or e - join < width - 8)), None)
                if meet is not None or whole:
                    break
                width *= 4
            cut = self._bytes_to_ids(ids, len(left[:keep].encode()))
            if meet is None:  # no agreement inside: both are one piece of text from here on
                out.append(ids[:cut])
                left = window
                ids = array("i", self.whole(left)).tobytes()
                continue
            out += [ids[:cut], array("i", self.whole(window[:meet])).tobytes()]
            rest = right[meet - join :]
            ids = right_ids[self._bytes_to_ids(right_ids, len(right[: meet - join].encode())) :]
            left = rest
        return b"".join([*out, ids])

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, bytes]:
        """(offsets, ids as bytes): the ids of all texts one behind the other; empty and null texts have none."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        data = b"".join([t for t in texts if t])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        at, safe = self.cuts(data, starts[sizes > 0])
        bounds = [*at.tolist(), len(data)]
        first = np.searchsorted(at, starts)
        last = np.searchsorted(at, ends)
        rough = np.concatenate([[0], np.cumsum(~safe)])
        rough = (rough[last] - rough[first]) > 0
        chunk, parts, offsets, total = self._chunk, [], [0], 0
        safe_list = safe.tolist()
        for i, (f, e) in enumerate(zip(first.tolist(), last.tolist())):
            if sizes[i]:
                if rough[i]:
                    got = []
                    k = f
                    while k < e:
                        group = [data[bounds[k] : bounds[k + 1]]]
                        k += 1
                        while k < e and not safe_list[k]:
                            group.append(data[bounds[k] : bounds[k + 1]])
                            k += 1
                        got.append(chunk(group[0]) if len(group) == 1 else self._repaired(group))
                    ids = b"".join(got)
                else:
                    ids = b"".join([chunk(data[bounds[k] : bounds[k + 1]]) for k in range(f, e)])
                parts.append(ids)
                total += len(ids) >> 2
            offsets.append(total)
        return np.array(offsets, np.int32), b"".join(parts)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of this worker."""
    return Encoder(path)


def encoded(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>): one row per row of ``documents``; an empty list for empty and null texts.

    No shuffle; rows, also repeated ones, are kept as they are, and other columns are left out. Very
    long texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4))
            stops = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
            for f, e in itertools.pairwise([0, *stops.tolist(), len(texts)]):
                if e > f:
                    offsets, ids = enc.batch(texts.slice(f, e - f).to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(f, e - f), lists], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def chunk_reuse(documents: DataFrame, path: str) -> DataFrame:
    """(chunks, distinct_chunks, bytes, repeated_bytes): one row that says how much of the texts stands in chunks that occur
    again, which is what reuse can save at most. Chunks are counted by digest over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [t.encode() for t in b.column(0).to_pylist() if t]
            data = b"".join(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            at, _ = enc.cuts(data, np.cumsum(sizes) - sizes) if data else (np.zeros(0, int), None)
            bounds = [*at.tolist(), len(data)]
            digests = [hashlib.blake2b(data[f:e], digest_size=16).digest() for f, e in itertools.pairwise(bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.diff(bounds), pa.int64())], names=["chunk", "size"])

    found = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk binary, size long")
    one = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.agg(total(F.col("n")).alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), total(F.col("n") * F.col("size")).alias("bytes"), total((F.col("n") - 1) * F.col("size")).alias("repeated_bytes"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path())


def p7_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse(table(spark, sf_dir, "documents"), vocabulary_path())


SQL: dict[str, str] = {}
QUERIES = {"p7_ids": p7_ids, "p7_reuse": p7_reuse}
