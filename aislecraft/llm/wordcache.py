"""Texts as runs of chunks that tokenise independently of each other, so that a frequent chunk is worked out once per worker.

A byte-level pre-tokeniser never joins what stands left and right of a single
space between two other characters: the space begins a new piece. A text is cut
there, and the cut chunks, each with its leading space, give together what the
whole text gives. Chunks can be cut further, into the pieces that no merge
crosses.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable

import regex

BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the plain space.
OTHER = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c != " "]
#: Splits text into pieces that no merge crosses; a fixed value of byte-level vocabularies.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters of a chunk or piece that is kept; longer ones are rare and are worked out each time.
KEPT = 64


def chunkable(path: str) -> bool:
    """Whether chunks of a tokenizer's file may be encoded apart: byte-level pieces by the usual expression, no normalizer, no added token with white space or with a side condition."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    alone = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    tokens = spec.get("added_tokens", [])
    return bool(plain and alone and all(t["content"].split() == [t["content"]] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in tokens))


def cut(text: str) -> list[str]:
    """The chunks of `text` without their leading spaces; every chunk but the first has one."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER):
        return BETWEEN.split(text)
    return text.split(" ")


class Generations:
    """A dict of bounded bytes: when the young entries fill half, they become the old ones, and of the old only those stay that are asked for again."""

    def __init__(self, limit: int):
        self.half, self.used = limit // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> None:
        self.used += 220 + 2 * len(key) + len(value)
        self.young[key] = value

    def turn(self) -> None:
        if self.used > self.half:
            self.old, self.young, self.used = self.young, {}, 0


class ChunkCache:
    """The ids of chunks, bounded in bytes; `encode_many` gives those of unknown ones, each with its leading space if it has one."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 96 << 20):
        self.encode_many, self.kept = encode_many, Generations(limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        cuts = [cut(x) for x in texts]
        young, old = self.kept.young, self.kept.old
        rows = [list(map(young.get, c)) for c in cuts]
        unknown: dict[str, bytes | None] = {}
        for c, row in zip(cuts, rows):
            row[0] = b""  # a first chunk has no leading space; it is no later one
            if None in row:
                unknown.update([(x, None) for x, v in zip(c, row) if v is None])
        fresh = []
        for x in unknown:
            if (v := old.get(x)) is None:
                fresh.append(x)
            else:
                unknown[x] = v
        done = self.encode_many([f" {x}" for x in fresh] + [c[0] for c in cuts])
        unknown.update(zip(fresh, done))
        for x, v in unknown.items():
            if len(x) <= KEPT:
                self.kept.put(x, v)
        out = []
        for c, row, head in zip(cuts, rows, done[len(fresh) :]):
            row[0] = head
            out.append(b"".join(row) if None not in row else b"".join([unknown[x] if v is None else v for x, v in zip(c, row)]))
        self.kept.turn()
        return out


class PieceCache:
    """The ids of pieces, bounded in bytes; `encode_pieces` gives those of unknown ones, `encode_whole` those of a chunk with one of the `special` tokens."""

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], encode_whole: Callable[[str], bytes], special: list[str], limit: int = 48 << 20):
        self.encode_pieces, self.encode_whole, self.special, self.kept = encode_pieces, encode_whole, special, Generations(limit)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks."""
        parts = [None if any(s in c for s in self.special) else PIECES.findall(c) for c in chunks]
        young, old = self.kept.young, self.kept.old
        found: dict[str, bytes] = {}
        unknown = []
        for p in {p for row in parts if row for p in row}:
            v = young.get(p)
            if v is None and (v := old.get(p)) is not None:
                self.kept.put(p, v)
            if v is None:
                unknown.append(p)
            else:
                found[p] = v
        for p, v in zip(unknown, self.encode_pieces(unknown)):
            found[p] = v
            if len(p) <= KEPT:
                self.kept.put(p, v)
        self.kept.turn()
        return [self.encode_whole(c) if row is None else b"".join(map(found.__getitem__, row)) for c, row in zip(chunks, parts)]
