"""Token ids as wavelet-matrix files: one compressed file per shard of documents.

A shard holds the ids of whole documents in ascending doc_id order. Its bit
planes are stored one below the other, the highest bit first; each plane is the
order that the planes above it leave behind (zeros first, then ones, stable).
The file also holds each plane's rank directory, and the planes in blocks that
are compressed apart: rank inflates the one block that it ends in. Rank gives
access to any token, counts of a token in any prefix and, with select, the
places where it occurs, without unpacking the ids.

Cases: a null or empty text has only the end id; null doc_ids come first;
repeated doc_ids keep a row each, in the order of a hash of their texts; a long
text is never divided; a tokenizer whose pieces may not be told from the text
alone encodes whole texts; an empty table gives no shards and no rows; columns
other than doc_id and text play no part.
"""

from __future__ import annotations

import codecs
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.llm.bpe import byte_letters
from aislecraft.llm.common import stored, texts_of, worker_cache
from aislecraft.llm.wordcache import ChunkCache, PieceCache, chunkable

#: Marks a file of this format.
MAGIC = b"WVMX2\n"
#: Tokens after which a shard is closed; a document is never divided.
SHARD_TOKENS = 1 << 18
#: Bits between two entries of a plane's rank directory; bytes of a plane that are compressed together.
RANK_STEP, PLANE_BLOCK = 512, 4096

#: The letters by which byte-level vocabularies write the bytes 0 to 255.
LETTERS = "".join(sorted(BYTES := byte_letters(), key=BYTES.get))

SHARDS = "part int, shard int, n_docs long, n_tokens long, content binary"
DECODED = "part int, shard int, place long, doc_id long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Bit planes of a sequence of ids with a directory of ranks, for rank and select."""

    def __init__(self, n: int, bits: int, planes: list, zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ranks = directory(planes) if ranks is None else ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = np.ascontiguousarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = np.compress(~one, x)
            zeros.append(len(low))
            x = np.concatenate((low, np.compress(one, x)))
        return cls(len(ids), bits, planes, zeros)

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one, out = np.unpackbits(self.planes[k][:], count=self.n, bitorder="little").view(bool), np.empty_like(x)
            out[np.flatnonzero(~one)] = x[: self.zeros[k]]
            out[np.flatnonzero(one)] = x[self.zeros[k] :] | x.dtype.type(1 << (self.bits - 1 - k))
            x = out
        return x

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first `i` bits of plane `k`: the directory's count, and the bits since."""
        block, rest = divmod(i, RANK_STEP)
        if not rest:
            return int(self.ranks[k][block])
        a = block * RANK_STEP // 8
        some = self.planes[k][a : a + (rest + 7) // 8]
        last = int(some[-1]) >> rest % 8 << rest % 8 if rest % 8 else 0  # bits from `i` on
        return int(self.ranks[k][block]) + int(np.bitwise_count(some).sum()) - (last & 255).bit_count()

    def access(self, i: int) -> int:
        """The id at place `i`."""
        found = 0
        for k in range(self.bits):
            ones = self._rank1(k, i)
            bit = self.planes[k][i >> 3] >> (i & 7) & 1
            found = found << 1 | int(bit)
            i = self.zeros[k] + ones if bit else i - ones
        return found

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, start), self._rank1(k, end)
            if token >> (self.bits - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often `token` stands in [start, end)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the `k`-th (from 0) occurrence of `token`; -1 if there is none."""
        a, b = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if k < 0 or k >= b - a:
            return -1
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select(self, k: int, bit: int, nth: int) -> int:
        """The place of the `nth` (from 0) such bit on plane `k`, by bisection on rank."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def locate(self, token: int) -> list[int]:
        """All places of `token`, in order."""
        return [self.select(token, k) for k in range(self.count(token))]


def directory(planes: list[np.ndarray]) -> list[np.ndarray]:
    """For each plane the ones before every RANK_STEP-th bit, the whole last."""
    step = RANK_STEP // 8
    return [np.concatenate(([0], np.cumsum(np.bitwise_count(np.pad(p, (0, -len(p) % step))).reshape(-1, step).sum(axis=1, dtype=np.uint32)))).astype("<u4") for p in planes]


class PackedPlane:
    """A plane of a file: blocks of PLANE_BLOCK bytes, inflated when they are asked for; the last one is kept."""

    def __init__(self, content: memoryview, sizes: list[int]):
        self.ends = np.cumsum(sizes)
        self.content, self.sizes, self.held = content, sizes, (-1, b"")

    def _block(self, k: int) -> bytes:
        if self.held[0] != k:
            end = int(self.ends[k])
            self.held = k, zstandard.ZstdDecompressor().decompress(self.content[end - self.sizes[k] : end])
        return self.held[1]

    def __getitem__(self, key: int | slice) -> np.ndarray | np.uint8:
        if not isinstance(key, slice):
            return np.uint8(self._block(key // PLANE_BLOCK)[key % PLANE_BLOCK])
        if key.start is None:
            return np.frombuffer(b"".join(map(self._block, range(len(self.sizes)))), np.uint8)
        first, last = key.start // PLANE_BLOCK, min((key.stop - 1) // PLANE_BLOCK, len(self.sizes) - 1)
        held = b"".join(map(self._block, range(first, last + 1)))
        return np.frombuffer(held, np.uint8)[key.start - first * PLANE_BLOCK : key.stop - first * PLANE_BLOCK]


def pack(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard's file: magic, header length, header, then compressed the document table, the planes' rank directories and the blocks of the planes."""
    m = WaveletMatrix.build(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.asarray(doc_ids.is_valid(), bool)
    table = [squeeze(np.asarray(doc_ids.fill_null(0), np.int64).tobytes()), squeeze(np.packbits(known).tobytes()), squeeze(lengths.astype(np.int64).tobytes()), squeeze(b"".join(r.tobytes() for r in m.ranks))]
    planes = [[squeeze(p[a : a + PLANE_BLOCK].tobytes()) for a in range(0, len(p), PLANE_BLOCK)] for p in m.planes]
    head = json.dumps({"docs": len(doc_ids), "n": m.n, "bits": bits, "zeros": m.zeros, "table": [*map(len, table)], "planes": [[*map(len, p)] for p in planes]}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *table, *(x for p in planes for x in p)))


def unpack(content: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """doc_ids, number of tokens of each document and the wavelet matrix of a shard's file, whose planes stay compressed until bits of them are asked for."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = len(MAGIC) + 4
    size = struct.unpack("<I", content[at - 4 : at])[0]
    head = json.loads(content[at : at + size])
    at, parts, view = at + size, [], memoryview(content)
    expand = zstandard.ZstdDecompressor().decompress
    for s in head["table"]:
        parts.append(expand(view[at : at + s]))
        at += s
    planes = []
    for sizes in head["planes"]:
        planes.append(PackedPlane(view[at : at + sum(sizes)], sizes))
        at += sum(sizes)
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=head["docs"]).view(bool)
    ranks = np.frombuffer(parts[3], "<u4").reshape(head["bits"], -1)
    return pa.array(np.frombuffer(parts[0], np.int64), mask=~known), np.frombuffer(parts[2], np.int64), WaveletMatrix(head["n"], head["bits"], planes, head["zeros"], list(ranks))


class Encoder:
    """What a worker keeps for one tokenizer of the library: its cache of chunks (none where texts have to be encoded whole), and the bits that an id needs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = ChunkCache(PieceCache(self._pieces, lambda text: self._many([text])[0], special).encode) if chunkable(path) else None

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces are cut already: the library's model takes them in the vocabulary's letters. No text has the byte 255, which parts them on the way."""
        model = self.tokenizer.model
        letters = codecs.charmap_decode(b"\xff".join([p.encode("utf-8", "replace") for p in pieces]), "strict", LETTERS)[0].split(LETTERS[255])
        rows = [[t.id for t in model.tokenize(x)] if x else [] for x in letters]
        raw, size, at, out = np.array([i for row in rows for i in row], self.kind).tobytes(), self.kind().itemsize, 0, []
        for row in rows:
            out.append(raw[at : at + size * len(row)])
            at += size * len(row)
        return out if pieces else []

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts) if self.cache else self._many(texts)


def encode_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards (part, shard, n_docs, n_tokens, content) of all texts in ascending doc_id order: part by part, shard by shard.

    The texts are range-partitioned by doc_id, equal ids by a hash of the text and
    equal rows by their place, so that every task encodes and writes a contiguous
    run of documents and no id is too many for one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Encoder = worker_cache(("wavelet", tokenizer_path), lambda: Encoder(tokenizer_path))
        size = encoder.kind().itemsize
        end, part, shard = np.array([end_id], encoder.kind).tobytes(), TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        runs: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(r) // size for r in runs], np.int64)
            content = pack(pa.concat_arrays(ids), lengths, np.frombuffer(b"".join(runs), encoder.kind), encoder.bits)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(runs)]), "n_tokens": pa.array([int(lengths.sum())]), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64)
                for k, raw in enumerate(encoder.encode([x or "" for x in rows.column(1).to_pylist()])):
                    ids.append(rows.column(0).slice(k, 1))
                    runs.append(raw + end)
                    held += len(runs[-1]) // size
                    if held >= shard_tokens:
                        yield close()
                        ids, runs, held, shard = [], [], 0, shard + 1
        if runs:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts_of(docs).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *key, "row")
    return dealt.sortWithinPartitions(*key).select("doc_id", "text").mapInArrow(run, SHARDS)


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shard files: doc_id, its place in the shard, its number of tokens and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, shard = batch.column(0).slice(k, 1), batch.column(1).slice(k, 1)
                ids, lengths, matrix = unpack(batch.column(2)[k].as_buffer().to_pybytes())
                raw, ends = memoryview(matrix.tokens().astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                same = lambda x: pa.array(np.full(len(ids), x[0].as_py(), np.int32))
                yield pa.RecordBatch.from_pydict({"part": same(part), "shard": same(shard), "place": pa.array(np.arange(len(ids))), "doc_id": ids, "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "shard", "content").mapInArrow(run, DECODED)


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Count of `token` in every shard, from the compressed files by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [unpack(x.as_buffer().to_pybytes())[2].count(token) for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"part": batch.column(0), "shard": batch.column(1), "n": pa.array(n, pa.int64())})

    return shards.select("part", "shard", "content").mapInArrow(run, "part int, shard int, n long")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents as shard files, read the files back and return doc_id, start, n_tokens, ids_crc32.

    `start` is the sum of all tokens before the document: sums over shards
    (a small table) give each shard's start, a window inside the shard the rest.
    """
    shards = stored(encode_shards(docs, tokenizer_path, end_id), "wavelet")
    sizes = shards.select("part", "shard", "n_tokens")
    return with_starts(read_shards(shards), sizes)


def with_starts(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_part = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(before_part, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    in_shard = Window.partitionBy("part", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inner = documents.withColumn("inner", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0)))
    return inner.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
