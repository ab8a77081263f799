"""Language identification by a bidirectional gated recurrent network over bytes.

The network runs over the bytes of a whole text, white space and punctuation
included, forwards and backwards, and gives every position a distribution over
the languages; a document's distribution is the mean over all its positions. So
that a long text is no long chain of steps, it is read in stretches of CHUNK
bytes, each with the REACH bytes before and after it as context: the states have
met those before the first position that counts, and every position counts once.
Training is backpropagation through time in numpy on a bounded sample.

Cases: a null text, or one without a letter, is `und` with score 0; a text of a
letter and other marks is labelled by all its bytes; ties go to the language
that sorts first; repeated rows have the same result each; with no row to learn
from everything is `und`; an empty table gives no rows; columns other than
doc_id, text and (for learning) lang play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import drawn, forget, learnable, texts_of

#: Bytes of a stretch, and of the context on both its sides.
CHUNK, REACH = 224, 16
#: Stretches that are worked through side by side.
LANES = 512
#: Units of each direction.
HIDDEN = 16
#: The sample to learn from: documents of each language, about, and bytes of one of them at most.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 16
#: Training: steps, and stretches of so many bytes in each.
STEPS, BATCH, WIDTH, RATE = 400, 192, 48, 0.02
LETTER = regex.compile(r"\p{L}")
#: The byte that stands outside a text; a state passes it unchanged.
OUTSIDE = 256


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: a squashing function as the hyperbolic tangent is, at a fraction of its cost. A gate is half of it, plus a half."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


class BiGRU:
    """Parameters by name, the two directions in the first axis: `x` (gate inputs of each byte), `u` and `b`; `o` and `c` for the labels. Lanes are the last axis everywhere."""

    def __init__(self, labels: list[str], parts: dict[str, np.ndarray] | None = None, seed: int = 1):
        self.labels, rng, h = labels, np.random.default_rng(seed), HIDDEN
        self.p = parts or {
            "x": rng.normal(0, 0.6, (2, 3 * h, 256)).astype(np.float32),
            "u": rng.normal(0, 2 * h**-0.5, (2, 3 * h, h)).astype(np.float32),
            "b": np.zeros((2, 3 * h, 1), np.float32),
            "o": rng.normal(0, 0.3, (len(labels), 2 * h)).astype(np.float32),
            "c": np.zeros((len(labels), 1), np.float32),
        }

    def _run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [T, 2, H, B] over the bytes x [T, B], those of the second direction from the last byte on; `keep` also keeps what training needs."""
        steps, lanes = x.shape
        kind, h2 = self.p["u"].dtype, 2 * HIDDEN
        stay = np.concatenate((np.full(HIDDEN, 1e30), np.zeros(h2))).astype(kind)[:, None]
        gates = np.concatenate((self.p["x"] + self.p["b"], np.broadcast_to(stay, (2, 3 * HIDDEN, 1))), axis=2)
        u, h, past = self.p["u"], np.zeros((2, HIDDEN, lanes), kind), []
        out, a, s = np.empty((steps, 2, HIDDEN, lanes), kind), np.empty((2, 3 * HIDDEN, lanes), kind), np.empty((2, 3 * HIDDEN, lanes), kind)
        for t in range(steps):
            np.take(gates[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(gates[1], x[steps - 1 - t], axis=1, out=a[1], mode="clip")
            np.dot(u[0], h[0], out=s[0])
            np.dot(u[1], h[1], out=s[1])
            zr = squash(s[:, :h2] + a[:, :h2])
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = r * s[:, h2:]
            n += a[:, h2:]
            squash(n)
            if keep:
                past.append((h, z, r, n, s[:, h2:].copy()))
            np.subtract(h, n, out=out[t])
            h = out[t]
            h *= z
            h += n
        return out, past

    def _labels(self, states: np.ndarray) -> np.ndarray:
        """Distributions [T, K, B]; the second direction's states are turned round."""
        y = self.p["o"][:, :HIDDEN] @ states[:, 0] + self.p["o"][:, HIDDEN:] @ states[::-1, 1] + self.p["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distributions [T, K, B] of every position of the bytes x [T, B]."""
        return self._labels(self._run(x)[0])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, y [B] being the stretches' languages."""
        states, past = self._run(x, True)
        e = self._labels(states)
        e[:, y, np.arange(len(y))] -= 1
        e /= e.shape[0] * e.shape[2]
        o = self.p["o"]
        g = {"o": np.concatenate([np.einsum("tkb,thb->kh", e, s, optimize=True) for s in (states[:, 0], states[::-1, 1])], axis=1), "c": e.sum(axis=(0, 2))[:, None], "u": np.zeros_like(self.p["u"])}
        back = np.stack((o[:, :HIDDEN].T @ e, (o[:, HIDDEN:].T @ e)[::-1]), axis=1)
        dh, das, ut = np.zeros_like(back[0]), np.empty((len(x), 2, 3 * HIDDEN, x.shape[1]), back.dtype), self.p["u"].transpose(0, 2, 1)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, sn = past[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * sn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            das[t] = np.concatenate((dz, dr, dn), axis=1)
            ds = np.concatenate((dz, dr, dn * r), axis=1)
            g["u"] += ds @ h.transpose(0, 2, 1)
            dh = dh * z + ut @ ds
        g["b"] = das.sum(axis=(0, 3))[:, :, None]
        g["x"] = np.zeros_like(self.p["x"])
        for d, bytes_ in enumerate((x, x[::-1])):
            order = np.argsort(bytes_, axis=None, kind="stable")
            seen, first = np.unique(bytes_.ravel()[order], return_index=True)
            rows = das[:, d].transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order]
            g["x"][d][:, seen] = np.add.reduceat(rows, first, axis=0).T
        return g

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adam on stretches of the texts, drawn by their lengths, every language as often as the others."""
        rng, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        width = min(WIDTH, max(map(len, texts)))
        flat = np.frombuffer(b"".join(t + b" " * width for t in texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + width for t in texts[:-1])])
        sizes = np.array([max(1, len(t) - width) for t in texts])
        share = sizes / np.bincount(y, sizes, len(self.labels))[y]
        share /= share.sum()
        for step in range(1, steps + 1):
            k = rng.choice(len(texts), BATCH, p=share)
            at = starts[k] + (rng.random(BATCH) * sizes[k]).astype(np.int64)
            rate = RATE * (1 - step / (steps + 1)) ** 0.5
            for name, g in self.gradients(flat[at + np.arange(width)[:, None]], y[k]).items():
                a, b = m[name]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' distributions; of an empty one, zeros."""
        sizes = np.array([len(t) for t in texts])
        flat, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK  # in its text
        length = np.minimum(CHUNK, sizes[owner] - begin)
        out, order = np.zeros((len(texts), len(self.labels))), np.argsort(-length, kind="stable")
        for a in range(0, len(order), LANES):
            lot = order[a : a + LANES]
            place = np.arange(-REACH, length[lot[0]] + REACH)[:, None] + begin[lot]  # [T, B], in its text
            inside = (place >= 0) & (place < sizes[owner[lot]])
            x = np.where(inside, flat[np.where(inside, place + starts[owner[lot]], 0)].astype(np.intp), OUTSIDE)
            p = self.positions(x)[REACH:-REACH]
            p *= (np.arange(len(p))[:, None] < length[lot])[:, None]
            np.add.at(out, owner[lot], p.sum(axis=0, dtype=np.float64).T)
        return out / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> BiGRU | None:
    """A network learnt from `docs` (doc_id, text, lang): about `sample_docs` documents of each language, drawn by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learnable(F.col("doc_id")), F.lit(False))).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = drawn(known, "lang", F.lit(float(sample_docs)), sample_bytes).collect()  # bounded by the two parameters for each language
    rows = [(r["label"], r["text"].encode("utf-8", "replace")) for r in sorted(sample, key=lambda r: (r["label"], r["key"])) if r["text"]]
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    network = BiGRU(labels)
    network.train([t for _, t in rows], np.array([labels.index(lang) for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: BiGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return annotated(texts_of(docs), network).select("doc_id", held, F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def labelled(docs: DataFrame, network: BiGRU | None, column: str) -> DataFrame:
    """`docs` with a struct `column` of lang and score."""
    if network is None:
        return docs.withColumn(column, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    labels, parts = network.labels, network.p

    @F.pandas_udf("lang string, score double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        net = BiGRU(labels, parts)
        for series in texts:
            out = []
            for a in range(0, len(series), 128):
                lot = ["" if x is None else x for x in series.iloc[a : a + 128]]
                share = net.pooled([x.encode("utf-8", "replace") for x in lot])
                for x, k, p in zip(lot, share.argmax(axis=1), np.clip(share.max(axis=1), 0, 1)):
                    out.append((labels[k], float(p)) if LETTER.search(x) else ("und", 0.0))
            yield pd.DataFrame(out, columns=["lang", "score"]).astype({"lang": object, "score": float})

    return docs.withColumn(column, label(F.col("text").cast("string")))


def annotated(docs: DataFrame, network: BiGRU | None) -> DataFrame:
    """`docs` (without columns of these names) with _lang and _lang_score."""
    return labelled(docs, network, "_found").select("*", F.col("_found.lang").alias("_lang"), F.col("_found.score").alias("_lang_score")).drop("_found")
