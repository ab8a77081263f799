"""N-gram Jaccard join with a token-group matrix.

A document is its set of distinct five-word shingles. Equal sets are one class.
Classes are partitioned into groups of similar ones: minhash bands propose a hub
for each class, exact overlaps confirm the links, and connected classes are one
group. The token-group matrix holds, for every token among the rarest fifth of a
member's tokens (the prefix without which a similarity of 0.8 is impossible), the
groups whose union has it. A class is asked against the groups of its own prefix
tokens; the bound on the overlap that is left from each shared token rules out
most groups. The remaining ones are opened in blocks of 64 members: the block's
token union, a 64-bit mask for each token, bounds the overlap once more and then
gives the exact overlap with every member. Confirmed links join groups, and
connected groups are the components.

Shingles, like sets, are compared by 64-bit hashes.

Cases: a null or empty text has an empty set and is linked with nothing; a text
of fewer than five words is one shingle; equal texts link; rows that share a
doc_id are one document with all their links; a row without doc_id has no
component; an empty table gives no rows; columns other than doc_id and text play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, forget, stored
from aislecraft.llm.graph import components, membership, packed_counts, slot, summed_counts

SIZE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Buckets that shingles are counted in, for an order from rare to frequent: so many for each document, within these powers of two.
BUCKETS_EACH, LEAST_BITS, MOST_BITS = 8, 18, 23
#: Minhash bands, and minima in each.
BANDS, ROWS = 12, 4
#: Members of a block, one for each bit of a mask; queries of a block that one task holds.
BLOCK, HELD = 64, 2048
#: Rows of one token that are counted together; of a token that may have more the count isn't needed.
HOT = 1 << 20
#: Bits that say whose sets are needed.
BITS = 1 << 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _A
    return h ^ h >> np.uint64(29)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """64-bit hashes of all shingles in order of the text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.empty(0, np.uint64)
    w = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h *= _B
        h += w[k : len(w) - size + 1 + k]
    return mixed(h)


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """Tokens of which two sets so similar share one at least: n minus the least overlap, plus 1."""
    return n - -(-similar * n // 100) + 1


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a sorted set: minima of its hashes in BANDS x ROWS bins, empty bins taking the next one's."""
    bins = (mixed(s * _B) % np.uint64(BANDS * ROWS)).astype(np.int64)
    where, first = np.unique(bins, return_index=True)
    nearest = np.searchsorted(where, np.arange(BANDS * ROWS)) % len(where)
    minima = s[first][nearest].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _B + minima[:, k])
    return key


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall into each bucket. Any order finds the same links; a finer one opens fewer groups."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BUCKETS_EACH * docs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, buckets(shingles(t.as_py()), bits), 1)
        if counts.any():
            yield pa.RecordBatch.from_pandas(packed_counts(counts), preserve_index=False)

    return summed_counts(docs.select("text").mapInArrow(run, "at long, counts binary"), 1 << bits)


def signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), v (hash of the set), bands, prefix (rarest tokens first) and often of every document.

    `often` bounds how often a token of the prefix occurs in all documents: its bucket's count.
    """
    spread = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))  # at most 2^MOST_BITS numbers

    bits = len(counts).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rarity = spread.value
        lists = lambda rows: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32), np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64))
        for batch in batches:
            sizes, hashes, keys, prefixes, often = [], [], [], [], []
            for t in batch.column(1):
                s = np.unique(shingles(t.as_py()))
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                keys.append(bands(s) if len(s) else s)
                seen = rarity[buckets(s, bits)] if len(s) else np.empty(0, np.float32)
                rarest = np.argsort(seen, kind="stable")[: prefix_length(len(s))] if len(s) else np.empty(0, np.int64)
                prefixes.append(s[rarest])
                often.append(seen[rarest].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), lists(keys), lists(prefixes), lists(often)], ["doc_id", "n", "v", "bands", "prefix", "often"])

    return docs.mapInArrow(run, "doc_id long, n long, v long, bands array<long>, prefix array<long>, often array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v and its sorted set, for the documents `wanted` (doc_id): worked out again from the texts, so that sets are never stored for all.

    Rows that repeat a doc_id repeat their set; links are sets too, so that this does no harm.
    """
    needed = docs.sparkSession.sparkContext.broadcast(np.packbits(membership(wanted, "doc_id", BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bits = needed.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            sets = [np.unique(shingles(t.as_py())) for t in batch.column(1)]
            v = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.ListArray.from_arrays(offsets, values)], ["v", "tokens"])

    with_slot = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", slot(F.col("doc_id"), BITS).alias("at"))
    return with_slot.mapInArrow(run, "v long, tokens array<long>")


def band_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes and the hubs of their bands."""
    rows = classes.select("v", "n", "rep", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("v", "n", "rep")).alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    pairs = rows.join(hubs, "key").where("v <> hub.v and 100 * least(n, hub.n) >= 80 * greatest(n, hub.n)")
    pairs = stored(pairs.select(F.col("v").alias("a"), F.col("hub.v").alias("b"), F.col("rep").alias("ra"), F.col("hub.rep").alias("rb")).distinct(), "pairs")
    sets = stored(sets_of(docs, pairs.select(F.col("ra").alias("doc_id")).union(pairs.select("rb")).distinct()), "sets")
    both = pairs.select("a", "b").join(sets.select(F.col("v").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("v").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    links = stored(both.where(100 * common >= SIMILAR * (F.size("ta") + F.size("tb") - common)).select("a", "b").distinct(), "links")
    discard(sets, pairs)
    return links


def shared_tokens(classes: DataFrame) -> DataFrame:
    """v, i, token of the prefix tokens that several classes may have: tokens are shuffled once, as narrow rows.

    A token that occurs once at most is left out before. One that may occur more than
    HOT times is counted in parts of about that many, and stays whatever a part's count.
    """
    tokens = classes.select("v", F.posexplode(F.arrays_zip("prefix", "often")).alias("i", "x")).select("v", "i", F.col("x.prefix").alias("token"), F.col("x.often").alias("often"))
    hot = F.col("often") > HOT
    part = F.when(hot, F.pmod(F.xxhash64("v"), F.ceil(F.col("often") / HOT))).otherwise(F.lit(0))
    several = tokens.where("often > 1").withColumn("part", part).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token", "part")))
    return stored(several.where((F.col("many") > 1) | hot).select("v", "i", "token"), "shared")


def group_candidates(shared: DataFrame, grouped: DataFrame) -> DataFrame:
    """(v, g): classes and the other groups that the token-group matrix doesn't rule out for them.

    Of two groups the one with the larger label asks the other.
    """
    tokens = shared.join(grouped.select("v", "g", "n"), "v")
    matrix = tokens.groupBy("token", "g").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("i")).alias("rest"))
    asked = tokens.select("token", "v", F.col("g").alias("own"), "n", "i")
    fits = "own > g and 100 * most_n >= 80 * n and 80 * least_n <= 100 * n"
    # an overlap o of sets of x and y tokens is enough when 180 o >= 80 (x + y); from the first shared token on, no more than the rest is shared
    least = F.greatest(F.col("least_n"), F.ceil(F.col("n") * SIMILAR / 100))
    bound = F.least(F.col("n") - F.col("i"), F.col("rest")) * (100 + SIMILAR) >= SIMILAR * (F.col("n") + least)
    return asked.join(matrix, "token").where(fits).where(bound).select("v", "g").distinct()


def opened(candidates: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) from candidates (v, g) by opening the groups, block by block."""
    asked = candidates.groupBy("g").agg(F.count(F.lit(1)).alias("asked"))
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("members")).join(asked, "g")
    shares = stored(sizes.select("g", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / HELD).cast("int").alias("turns")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = classes.join(shares, "g").select("v", "rep", "g", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), every("turns").alias("turn"))
    queries = candidates.join(shares, "g").select("v", "g", every("blocks").alias("block"), F.pmod(F.xxhash64("v"), F.col("turns")).cast("int").alias("turn"))
    queries = queries.join(classes.select("v", "rep"), "v")
    rows = stored(members.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True))), "opened")
    sets = sets_of(docs, rows.select(F.col("rep").alias("doc_id")).distinct())
    shipped = rows.drop("rep").join(sets, "v")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        inside = pdf[~asks]
        a, b = [], []
        for start in range(0, len(inside), BLOCK):
            part = inside.iloc[start : start + BLOCK]
            flat = np.concatenate(part["tokens"].to_list())
            sizes = part["tokens"].map(len).to_numpy()
            union, place = np.unique(flat, return_inverse=True)
            masks = np.zeros(len(union), np.uint64)
            np.bitwise_or.at(masks, place, np.repeat(np.uint64(1) << np.arange(len(part), dtype=np.uint64), sizes))
            for v, tokens in zip(pdf["v"].to_numpy()[asks], pdf["tokens"][asks]):
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                hit = masks[at[union[at] == tokens]]
                if (100 + SIMILAR) * len(hit) < SIMILAR * (len(tokens) + sizes.min()):
                    continue  # the union bounds the overlap with every member
                common = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)[: len(part)]
                ok = 100 * common >= SIMILAR * (sizes + len(tokens) - common)
                a += [v] * int(ok.sum())
                b += part["v"].to_numpy()[ok].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return shipped.groupBy("g", "block", "turn").applyInPandas(verify, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = stored(signatures(texts, shingle_counts(texts)), "signatures")
    found = stored(wide.select("doc_id", "n", "v"), "sizes")
    full = found.where("n > 0 and doc_id is not null")
    classes = wide.where("n > 0 and doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"), F.first("often").alias("often"))
    classes = stored(classes, "classes")
    discard(wide)
    links = band_links(classes, texts)
    groups = components(links)
    shared = shared_tokens(classes)
    slim = stored(classes.select("v", "rep", "n").join(groups.withColumnRenamed("id", "v"), "v", "left").select("v", "rep", "n", F.coalesce("label", "v").alias("g")), "grouped")
    discard(classes)
    candidates = stored(group_candidates(shared, slim), "candidates")
    discard(shared)
    more = opened(candidates, slim, texts)
    of = slim.select("v", "g")
    between = more.join(of.select(F.col("v").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    # rows that share a doc_id are one document
    ids = full.select("doc_id", "v").distinct()
    several = ids.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("doc_id", "a")
    same = several.join(ids, "doc_id").where("a <> v").select("a", F.col("v").alias("b"))
    same = same.join(of.select(F.col("v").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    merged = components(stored(between.union(same), "links"))
    whole = slim.join(merged.withColumnRenamed("id", "g"), "g", "left").select("v", "rep", F.coalesce("label", "g").alias("c"))
    least = whole.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_class = whole.join(least, "c").select("v", "component_id")
    out = found.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("v")).alias("v")).join(by_class, "v", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component stays, the one of the smallest doc_id; rows without doc_id stay all."""
    first = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    # of rows that share the doc_id the one whose text, then whose whole row, sorts first
    row = F.struct(F.struct("text", F.xxhash64(*docs.columns)).alias("order"), F.struct(*docs.columns).alias("row"))
    least = kept.groupBy("doc_id").agg(F.min_by(row["row"], row["order"]).alias("row")).select("row.*")
    return least.unionByName(docs.where(F.col("doc_id").isNull()))
