"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of a word's tree are the merge ranks of its adjacent symbol pairs,
each with its place, so that the root is the leftmost pair of the lowest rank.
A merge changes three leaves (the pair itself, the pair on its left and the one
that vanishes on its right), each with an update of logarithmic cost, until the
root says that no pair can be merged. Words of similar length are worked through
together, one tree for each, as columns of one array.

Cases: a null text is an empty one and has no ids; very long words have a tree
of their own; ties between equal pairs go to the leftmost; repeated rows keep a
row each; a null doc_id stays null; an empty table gives no rows; a tokenizer
file of another kind is an error; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from aislecraft.llm.common import texts_of, worker_cache
from aislecraft.llm.wordcache import PIECES, ChunkCache, PieceCache, chunkable

#: Pieces of more symbols than this have a tree of their own.
LONG = 64
#: A rank above all others: no merge.
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class BPE:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, model = spec["model"]["vocab"], spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.merge = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.rank, self.made)}
        self.breaks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pair stands in `keys`, or -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        at = self._pair(left, right)
        return np.where(at < 0, NONE, self.rank[at] * width + place)

    def merge_block(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of words of 2 to LONG bytes, one tree for each, side by side."""
        n, longest = len(words), max(map(len, words))
        width = 1 << (longest - 2).bit_length() if longest > 2 else 1
        sym = np.full((n, longest + 1), -1, np.int64)
        sizes = np.array([len(w) for w in words])
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        sym[:, :longest][np.arange(longest) < sizes[:, None]] = flat
        nxt = np.tile(np.arange(1, longest + 2), (n, 1))
        prev = np.tile(np.arange(-1, longest), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        pairs = longest - 1
        tree[:, width : width + pairs] = self._leaf(sym[:, :pairs], sym[:, 1 : pairs + 1], np.arange(pairs), width)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            k = place + width
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        root = min(1, 2 * width - 1)
        rows = np.flatnonzero(tree[:, root] < NONE)
        while len(rows):
            i = tree[rows, root] % width
            j = nxt[rows, i]
            sym[rows, i] = left = self.made[self._pair(sym[rows, i], sym[rows, j])]
            sym[rows, j] = -1
            after = nxt[rows, j]
            nxt[rows, i] = after
            inside = after < longest
            prev[rows[inside], after[inside]] = i[inside]
            gone = j < width
            if gone.any():
                put(rows[gone], j[gone], np.full(int(gone.sum()), NONE))
            put(rows, i, self._leaf(left, sym[rows, np.minimum(after, longest)], i, width))
            before = prev[rows, i]
            has = before >= 0
            if has.any():
                put(rows[has], before[has], self._leaf(sym[rows[has], before[has]], left[has], before[has], width))
            rows = rows[tree[rows, root] < NONE]
        kept = sym >= 0
        raw, ends = sym[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_one(self, word: bytes) -> bytes:
        """The same for one word of any length."""
        sym: list[int] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        if n < 2:
            return np.array(sym, "<u4").tobytes()
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        none, merge = int(NONE), self.merge

        def leaf(i: int, j: int) -> int:
            found = merge.get(sym[i] << 20 | sym[j]) if 0 <= i and j < n else None
            return none if found is None else found[0] * width + i

        tree = [none] * width + [leaf(i, i + 1) for i in range(n - 1)] + [none] * (width - n + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = i + width
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                new = a if a < b else b
                if tree[k] == new:
                    break
                tree[k] = new

        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        root = min(1, 2 * width - 1)
        while tree[root] < none:
            i = tree[root] % width
            j = nxt[i]
            sym[i] = merge[sym[i] << 20 | sym[j]][1]
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if j < width:
                put(j, none)
            put(i, leaf(i, nxt[i]))
            if prev[i] >= 0:
                put(prev[i], leaf(prev[i], i))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = nxt[i]
        return np.array(out, "<u4").tobytes()

    def merge_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of every distinct word."""
        out: dict[bytes, bytes] = {b"": b""}
        lots: dict[int, list[bytes]] = {}
        for w in set(words):
            if len(w) < 2 or len(w) > LONG:
                out[w] = self.merge_one(w)
            else:
                lots.setdefault((len(w) - 2).bit_length(), []).append(w)
        for lot in lots.values():
            for a in range(0, len(lot), 4096):
                out.update(zip(lot[a : a + 4096], self.merge_block(lot[a : a + 4096])))
        return out

    def _plain(self, text: str) -> list[tuple[bool, str]]:
        """Runs of ordinary text (True) and special tokens (False)."""
        if not self.breaks or not any(t in text for t in self.special):
            return [(True, text)]
        out, at = [], 0
        for m in self.breaks.finditer(text):
            out += [(True, text[at : m.start()]), (False, m[0])]
            at = m.end()
        return [*out, (True, text[at:])]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian uint32."""
        cut = [[[p.encode() for p in PIECES.findall(run)] if plain else run for plain, run in self._plain(t)] for t in texts]
        done = self.merge_words([p for runs in cut for r in runs if isinstance(r, list) for p in r])
        return [b"".join(b"".join(map(done.__getitem__, r)) if isinstance(r, list) else np.array([self.special[r]], "<u4").tobytes() for r in runs) for runs in cut]


class Model:
    """What a worker keeps for one tokenizer: the vocabulary, its cache of chunks, and the bytes of all tokens in one array."""

    def __init__(self, path: str):
        self.bpe = BPE(path)
        if not chunkable(path):
            raise ValueError(f"{path} is not a byte-level vocabulary with the usual pieces")
        self.pieces = PieceCache(self._pieces, lambda text: self.bpe.encode_many([text])[0], list(self.bpe.special))
        self.cache = ChunkCache(self.pieces.encode)
        size = 1 + max(self.bpe.bytes_of, default=0)
        each = [self.bpe.bytes_of.get(i, b"") for i in range(size)]
        self.sizes = np.array([*map(len, each), 0], np.int64)  # the last one stands for unknown ids
        self.starts, self.blob = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(each), np.uint8)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        done = self.bpe.merge_words(raw)
        return [done[r] for r in raw]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian uint32."""
        return self.cache.encode(texts)

    def raw(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; unknown ids stand for none."""
        i = np.minimum(np.frombuffer(ids, "<u4"), len(self.sizes) - 1)
        sizes = self.sizes[i]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[i] - ends + sizes, sizes)].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.raw(ids).decode("utf-8", "replace")


def model(path: str) -> Model:
    """The worker's model."""
    return worker_cache(("bpe", path), lambda: Model(path))


def encode_decode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with `keep_ids` also ids (binary) and decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = model(tokenizer_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = tokens.encode([x or "" for x in part.column(1).to_pylist()])
                back = [tokens.decode(x) for x in ids]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                }
                if keep_ids:
                    out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(back, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")
    return texts_of(docs).mapInArrow(run, schema)
