"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to rows of an
embedding table; a document is the mean of its distinct words' vectors and of
PAD zero vectors (which keep a few words from deciding much), a word's vector
being the mean of its subwords'. Embeddings and softmax are trained jointly in
numpy on a bounded sample of labelled documents, so that an unseen misspelling
shares the vectors of the n-grams that it keeps. As everything below the softmax
is a mean, a word adds a fixed pair of numbers to a document and is worked out
once per worker.

Cases: a null or empty text has the score of an empty bag, which is the share of
toxic rows learnt from; with no row to learn from every score is 0; a document
with several labels counts with each; unlabelled rows are scored all the same;
repeated rows are learnt from once and scored each; an empty table gives no rows; columns other than doc_id and text (and toxic in
the labels) play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import drawn, learnable, texts_of, worker_cache
from aislecraft.llm.wordtable import WordTable

#: Rows of the embedding table, and its width.
BUCKETS, WIDTH = 1 << 17, 4
#: Lengths in bytes of the n-grams of a word in its marks < and >.
GRAMS = (3, 4, 5, 6)
#: Labelled documents to learn from, about: of class 0 and of class 1; bytes of one of them at most.
SAMPLE_DOCS, SAMPLE_BYTES = (5000, 2500), 1 << 15
#: How many times as many labels are drawn before their texts are known, of which some are missing or too long.
SPARE = 2.0
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 600, 64, 0.03, 1e-2
#: Zero vectors that take part in every mean.
PAD = 20
#: Letters of a word that take part in one bag; a longer one is cut into several words.
LONGEST = 40
#: A score from which on a document counts as toxic.
THRESHOLD = 0.7
MARKS = ".,;:!?\"'()[]{}*%&$#@-_/\\|<>=+~`^"


def words_of(text: str) -> list[str]:
    """Distinct lower-case words; one longer than LONGEST counts as several."""
    found = list(dict.fromkeys(text.lower().split()))
    if len(max(found, key=len, default="")) > LONGEST:
        found = list(dict.fromkeys(w[a : a + LONGEST] for w in found for a in range(0, len(w), LONGEST)))
    return found


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and owner (place in `words`) of every subword, for all words at once."""
    raw = [b"<" + (w.strip(MARKS) or w).encode("utf-8", "replace") + b">" for w in words]
    sizes = np.array([len(r) for r in raw])
    text, start = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(text))  # bytes from here to the word's end
    buckets, owners = [], []
    h = np.full(len(text), 2166136261, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(text) - n + 1]
        h = (h ^ text[n - 1 :]) * np.uint32(16777619)
        if n in GRAMS:
            ok = left[: len(h)] >= n
            g = h[ok]
            buckets.append((g ^ g >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(7))
            owners.append(owner[: len(h)][ok])
    # the word itself: a hash of all its bytes by their places
    place = (np.arange(len(text)) - start[owner]).astype(np.uint32)
    mixed = (text + np.uint32(1)) * (place * np.uint32(2654435761) + np.uint32(374761393))
    mixed ^= mixed >> np.uint32(13)
    buckets.append(np.add.reduceat(mixed * np.uint32(3266489917), start).astype(np.uint32) >> np.uint32(3))
    owners.append(np.arange(len(raw)))
    return (np.concatenate(buckets) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(owners)


class SubwordSoftmax:
    """Embeddings `e`, softmax weights `w` and bias `b` of two classes."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> None:
        """Adam on documents given as (bucket, weight), the weights of each adding up to less than 1."""
        rng = np.random.default_rng(seed)
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in "ewb"}
        batches = -(-len(docs) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
        step, steps = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), BATCH):
                lot, step = order[a : a + BATCH], step + 1
                rows = np.concatenate([docs[k][0] for k in lot])
                share = np.concatenate([docs[k][1] for k in lot])[:, None]
                sizes = np.array([len(docs[k][0]) for k in lot])
                starts = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(self.e[rows] * share, starts, axis=0) * (sizes > 0)[:, None]
                s = mean @ self.w + self.b
                s = np.exp(s - s.max(axis=1, keepdims=True))
                g = s / s.sum(axis=1, keepdims=True)
                g[np.arange(len(lot)), y[lot]] -= 1
                g /= len(lot)
                back = np.repeat((g @ self.w.T).astype(np.float32), sizes, axis=0) * share
                ge = np.stack([np.bincount(rows, back[:, k], BUCKETS) for k in range(WIDTH)], axis=1).astype(np.float32)
                rate = RATE * (1 - step / (steps + 1))
                for k, grad in (("w", mean.T @ g), ("b", g.sum(axis=0)), ("e", ge + DECAY / len(docs) * self.e)):
                    m, v = state[k]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    getattr(self, k)[...] -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1, and the bias."""
        return self.e @ (self.w[:, 1] - self.w[:, 0]), float(self.b[1] - self.b[0])


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of a text: each distinct word has an equal share, and each subword an equal share of its word."""
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.float32)
    buckets, owner = subwords(words)
    share = (1 / (len(words) + PAD) / np.bincount(owner, minlength=len(words)))[owner]
    rows, inverse = np.unique(buckets, return_inverse=True)
    return rows.astype(np.uint32), np.bincount(inverse, share).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: tuple[int, int] = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float] | None:
    """Margins of a model learnt from `docs` (doc_id, text) with `labels` (doc_id, toxic): about `sample_docs` of each class, drawn by hash."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.coalesce(learnable(F.col("doc_id")), F.lit(False))).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    most = F.element_at(F.array(*(F.lit(float(n)) for n in sample_docs)), F.col("label") + 1)
    rates = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", (SPARE * most / F.col("n")).alias("rate"))  # two rows
    place = F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = known.join(F.broadcast(rates), "label").where(place < F.col("rate")).select("doc_id", F.col("label").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = texts.join(F.broadcast(ids), "doc_id")  # about SPARE times the sample's rows, whatever the input: no text is shuffled for the join
    picked = drawn(marked, "toxic", most, sample_bytes).collect()  # bounded by the two parameters
    rows = sorted(((r["key"], r["label"], r["text"]) for r in picked), key=lambda r: r[:2])
    if not rows:
        return None
    y = np.array([r[1] for r in rows])
    bags = [bag(r[2]) for r in rows]
    full = [k for k, b in enumerate(bags) if len(b[0])]
    rng = np.random.default_rng(3)  # the rarer class counts as much as the other
    counts = np.bincount(y[full], minlength=2)
    order = np.concatenate([np.concatenate((lot, rng.choice(lot, max(0, min(counts.max(), 4 * len(lot)) - len(lot))))) for c in (0, 1) if len(lot := np.array([k for k in full if y[k] == c], int))]) if full else np.empty(0, int)
    model = SubwordSoftmax()
    if len(order):
        model.train([bags[k] for k in order], y[order])
    return model.margins()


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ids = texts_of(docs)
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    if model is None:
        return ids.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    spread = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input
    key = hash(model[0].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = spread.value

        def rows(words: list[str]) -> np.ndarray:
            buckets, owner = subwords(words)
            n = np.bincount(owner, minlength=len(words))
            return np.stack((np.bincount(owner, margins[buckets], len(words)) / n, np.ones(len(words))), axis=1)

        known: WordTable = worker_cache(("toxicity", key), lambda: WordTable(rows, 2))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sums = known.sums([words_of(x) if x else [] for x in part.column(1).to_pylist()])
                odds = sums[:, 0] / (sums[:, 1] + PAD) + bias
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))})

    out = ids.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
