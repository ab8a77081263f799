"""Similarity of columns of a long matrix (row, col, value).

All kernels share `pair_sums`: columns are dealt into blocks of near-equal
work, rows are sent whole, packed, to the blocks that they reach, in rounds where
that is much, and a block's sums are formed and cut to the best neighbours where they are. Single
pairs are never shuffled, but for columns so frequent that several tasks share
them. `row_pairs` and `companions` give the pairs of each row by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.operators.ingest import places, prefix_sums
from aislecraft.operators.ranking import top_k
from aislecraft.sources.storage import stored


#: Entries of a row that one key of a join, or one array of `pair_sums`, takes; longer rows are dealt into blocks.
BLOCK = 1024

#: Pairs (with those of the other direction) that a block of `pair_sums` forms, twice as many at most but for more frequent columns, which are sliced; and pairs formed at once.
WORK, AT_ONCE = 4_000_000, 1_000_000

#: Blocks whose pairs all leave them are smaller by this factor: a task returns them at once.
ALL = 4

#: Blocks for each core, of any work, where the whole matrix is no more than WORK entries.
BLOCKS_OF_CORE = 3

#: Entries that a round of `pair_sums` sends to its blocks, or so many times those of the matrix where that is more; and entries that a task deals at once.
ROUND, MATRICES, DEALT = 100_000_000, 4, 2_000_000

#: Bytes of units that a task packs at once.
PACKED = 64_000_000

#: Sums are formed row by row where a column's rows have so many entries in the mean.
LONG = 1000

#: Sums are counted in place, not sorted, where so many places come to a pair.
DENSE = 8


def _dealt(matrix: DataFrame) -> DataFrame:
    """row, col, value with the number of blocks of the row and the entry's own."""
    long = matrix.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1))
    return matrix.select("row", "col", "value").join(long, "row", "left").select("row", "col", "value", blocks.alias("_blocks"), F.pmod(F.xxhash64("col"), blocks).cast("int").alias("_b"))


def row_pairs(matrix: DataFrame) -> DataFrame:
    """row, i, vi, j, vj: the entries of each row in pairs, i < j, each pair once; however long a row is, no key of the join has more than about BLOCK entries."""
    dealt = _dealt(matrix)
    a = dealt.select("row", F.col("_b").alias("p"), F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("q"), F.struct("col", "value").alias("a"))
    b = dealt.select("row", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("p"), F.col("_b").alias("q"), F.struct("col", "value").alias("b"))
    met = a.join(b, ["row", "p", "q"]).where("p < q or a.col < b.col")
    low, high = F.when(F.expr("a.col < b.col"), F.col("a")).otherwise(F.col("b")), F.when(F.expr("a.col < b.col"), F.col("b")).otherwise(F.col("a"))
    return met.select("row", low.alias("a"), high.alias("b")).select("row", F.col("a.col").alias("i"), F.col("a.value").alias("vi"), F.col("b.col").alias("j"), F.col("b.value").alias("vj"))


def companions(matrix: DataFrame, anchors: DataFrame) -> DataFrame:
    """i, j, n: in how many rows of `matrix` (row, col) a column i of `anchors` (col) and another column j are found together."""
    dealt = _dealt(matrix.withColumn("value", F.lit(1)))
    grid = lambda: F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    a = dealt.join(anchors.select("col").distinct(), "col", "left_semi").select("row", F.col("_b").alias("p"), grid().alias("q"), F.col("col").alias("i"))
    b = dealt.select("row", grid().alias("p"), F.col("_b").alias("q"), F.col("col").alias("j"))
    return a.join(b, ["row", "p", "q"]).where("i <> j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def pair_sums(matrix: DataFrame, least: int = 1, halves: bool = False, others_only: bool = False, norms: DataFrame | None = None, best: tuple[int, Callable] | None = None) -> DataFrame:
    """i, j, dot, n, si, sj: for columns i and j of `matrix` with common rows the sum of products, the number of these rows and both norms.

    Pairs with fewer than `least` common rows go. halves: only i < j.
    others_only: the sum of j's values instead of products. norms (col, s): in
    place of the sums of squares. best: k and a function of dot, n, si and sj
    (numpy arrays); only its k largest values for each i stay, ties to the
    smaller j, zeros left out.

    Where fewer pairs are returned than formed and rows reach many blocks, so
    many blocks at once are formed and stored as ROUND allows: the disk holds
    one round's units, however many there are.
    """
    matrix = matrix.where("row is not null and col is not null").select("row", "col", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    kind, spark = dict(matrix.dtypes)["col"], matrix.sparkSession
    if norms is None:
        entries = matrix.join(matrix.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("s")), "col")
    else:
        entries = matrix.join(norms.select("col", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s")), "col", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    rows = stored(entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value", "s"))).alias("c")).select("c"), "rows")
    placed = prefix_sums(rows.select(F.explode("c.col").alias("col"), F.size("c").alias("_len")).groupBy("col").agg(F.sum("_len").alias("_work")), "_work", F.col("col").asc())
    size, total = rows.agg(F.coalesce(F.sum(F.size("c")), F.lit(0))).first()[0], placed.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    work = max(WORK, total // (BLOCKS_OF_CORE * spark.sparkContext.defaultParallelism)) if size <= WORK else WORK  # a block never holds more than the matrix
    work = work if best is not None else -(-WORK // ALL)
    blocks = placed.groupBy(F.expr(f"start div {work}L").alias("_b")).agg(F.min("col").alias("first"), F.sum("_work").alias("_all")).orderBy("_b").collect()  # a row for each block
    bounds = np.array([r["first"] for r in blocks], object if kind == "string" else np.int64)
    slices = np.array([-(-r["_all"] // work) if r["_all"] > 2 * work else 1 for r in blocks], np.int64)
    schema = f"i {kind}, j {kind}, dot double, n long, si double, sj double"

    def formed(first: int, last: int) -> DataFrame:
        units = rows.mapInArrow(_dealt_units(bounds, slices, first, last, halves), UNITS)
        sums = lambda whole, least, best: units.where(F.col("whole") == whole).groupBy("block", "slice").applyInArrow(lambda table: _block_sums(_units(table, kind), kind, least, halves, others_only, best, AT_ONCE), schema)
        found = sums(True, least, best)
        if (slices[first:last] == 1).all():
            return found
        summed = sums(False, 1, None).groupBy("i", "j").agg(F.sum("dot").alias("dot"), F.sum("n").alias("n"), F.max("si").alias("si"), F.max("sj").alias("sj"))
        return found.unionByName(summed.where(F.col("n") >= least))

    cuts = [0, len(blocks)]
    if (best is not None or least > 1) and min(total, size * len(blocks)) > ROUND:  # units have no more entries than pairs
        entries_of = np.zeros(len(blocks), np.int64)
        reach = rows.mapInArrow(_reach(bounds, halves), "block long, entries long").groupBy("block").agg(F.sum("entries").alias("entries")).collect()  # a row for each block
        entries_of[[r["block"] for r in reach]] = [r["entries"] for r in reach]
        upto = np.cumsum(entries_of)
        cuts = [0, *(np.flatnonzero(np.diff((upto - 1) // max(ROUND, MATRICES * size))) + 1).tolist(), len(blocks)]
    if len(cuts) == 2:
        return formed(*cuts)
    out = None
    for first, last in zip(cuts, cuts[1:]):
        one = stored(formed(first, last), "sums")
        out = one if out is None else out.unionByName(one)
    return out


UNITS = "block long, slice int, whole boolean, runs int, entries int, width int, reach binary, first binary, many binary, cols binary, values binary, norms binary"


def _runs(batch: pa.RecordBatch, bounds: np.ndarray, halves: bool) -> tuple[np.ndarray, ...]:
    """Of rows of entries (col, value, s) in the order of their columns: the entries, where rows begin, and a run for each row and block: its row, block, first place in the row, entries, and how many entries it meets."""
    n = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column(0).flatten()
    col, value, norm = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    row, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    block = np.searchsorted(bounds, col, "right") - 1
    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1]))))
    of, first = row[starts], starts - begin[row[starts]]
    return col, value, norm, begin, of, block[starts], first, np.diff(np.append(starts, len(row))), n[of] - (first if halves else 0)


def _reach(bounds: np.ndarray, halves: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many entries the rows send to each block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(bounds), np.int64)
        for batch in batches:
            if batch.num_rows:
                *_, block, _, _, reach = _runs(batch, bounds, halves)
                many += np.bincount(block, reach, len(bounds)).astype(np.int64)
        yield pa.record_batch([pa.array(np.flatnonzero(many)), pa.array(many[many > 0])], names=["block", "entries"])

    return counted


def _dealt_units(bounds: np.ndarray, slices: np.ndarray, first: int, last: int, halves: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows dealt into the blocks from `first` to before `last`: the entries of the rows that reach a block, compressed, with the run of each row that is the block's own; with `halves` none before it."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col, value, norm, begin, row, block, at, many, reach = _runs(batch, bounds, halves)
            here = np.flatnonzero((block >= first) & (block < last))
            upto, a = np.cumsum(reach[here]), 0
            while a < len(here):
                b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + DEALT, "right")), a + 1)
                runs, a = here[a:b], b
                part = row[runs] % slices[block[runs]]
                order = np.lexsort((part, block[runs]))
                runs, part = runs[order], part[order]
                starts = np.flatnonzero(np.concatenate(([True], (block[runs][1:] != block[runs][:-1]) | (part[1:] != part[:-1]))))
                out = [_unit(col, value, norm, begin[row[x]] + (at[x] if halves else 0), reach[x], at[x] * (not halves), many[x]) for x in np.split(runs, starts[1:])]
                heads = [pa.array(block[runs][starts]), pa.array(part[starts].astype(np.int32)), pa.array(slices[block[runs][starts]] == 1)]
                kinds = [pa.int32()] * 3 + [pa.binary()] * 6
                yield pa.record_batch(heads + [pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in UNITS.split(", ")])

    return units


def _unit(col: np.ndarray, value: np.ndarray, norm: np.ndarray, begin: np.ndarray, reach: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple:
    """Entries from `begin` on: ids as differences of the narrowest type, numbers by the places of their bytes."""
    at = np.repeat(begin - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
    ids, width = col[at], 0
    packed = lambda x: pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)
    planes = lambda x: packed(np.ascontiguousarray(x, "<f8").view(np.uint8).reshape(-1, 8).T)
    if ids.dtype == object:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(pa.record_batch([pa.array(ids, pa.string())], names=["id"]))
        ids = sink.getvalue().to_pybytes()
    else:
        steps = np.diff(ids.astype(np.int64), prepend=0)
        low, high = steps.min(), steps.max()
        width = next(w for w in (2, 4, 8) if w == 8 or (low >= -(2 ** (8 * w - 1)) and high < 2 ** (8 * w - 1)))
        ids = packed(steps.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T)
    return len(reach), len(at), width, *(packed(x.astype("<i4").view(np.uint8).reshape(-1, 4).T) for x in (reach, first, many)), ids, planes(value[at]), planes(norm[at])


def _units(table: pa.Table, kind: str) -> pa.Table:
    """own_* and other_* (col, value, s) of the units of a block."""

    def planes(raw: bytes, width: int, n: int, of: str) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * width, codec="zstd"), np.uint8).reshape(width, n).T).view(f"<{of}{width}").ravel()

    parts = []
    for x in (dict(zip(table.column_names, r)) for r in zip(*(table[c].to_pylist() for c in table.column_names))):
        runs = [planes(x[c], 4, x["runs"], "i").astype(np.int64) for c in ("reach", "first", "many")]
        ids = pa.ipc.open_stream(x["cols"]).read_all()["id"].to_numpy() if kind == "string" else np.cumsum(planes(x["cols"], x["width"], x["entries"], "i"), dtype=np.int64)
        parts.append((*runs, ids, planes(x["values"], 8, x["entries"], "f"), planes(x["norms"], 8, x["entries"], "f")))
    reach, first, many, *entries = (np.concatenate(c) for c in zip(*parts))
    del parts
    begin = np.cumsum(reach) - reach
    own = np.repeat(begin + first - np.cumsum(many) + many, many) + np.arange(many.sum())
    offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    lists = {}
    for c, x in zip(("col", "value", "s"), entries):
        lists[f"own_{c}"] = pa.ListArray.from_arrays(offsets(many), pa.array(x[own]))
        lists[f"other_{c}"] = pa.ListArray.from_arrays(offsets(reach), pa.array(x))
    return pa.table(lists)


def _packed(batches: Iterator[pa.RecordBatch], *order: str) -> Iterator[pa.RecordBatch]:
    """Units of one block and slice as compressed Arrow streams: a row's entries go to several blocks, and ids, values and norms take a fraction of their size, less in an order."""

    def streams(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("block", "slice", *order)]).combine_chunks()
        block, slice_ = table["block"].to_numpy(), table["slice"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (slice_[1:] != slice_[:-1]))))
        units, out = table.drop_columns(["block", "slice"]), []
        for a, b in zip(starts, np.append(starts[1:], len(block))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, units.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(units.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(block[starts]), pa.array(slice_[starts]), pa.array(out, pa.binary())], names=["block", "slice", "units"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACKED:
            yield streams(held)
            held, size = [], 0
    if held:
        yield streams(held)


def _unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["units"]])


def _block_sums(table: pa.Table, kind: str, least: int, halves: bool, others_only: bool, best: tuple[int, Callable] | None, at_once: int) -> pa.Table:
    """The sums of a block, from units of some of a row's entries in the block (own_*) and some of all its entries (other_*); of so many pairs at once, more only of one column."""
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda c: pc.list_value_length(table[c]).to_numpy().astype(np.int64)
    reach = sizes("other_col")
    begin, unit = np.cumsum(reach) - reach, np.repeat(np.arange(table.num_rows), sizes("own_col"))
    own, own_at = np.unique(flat("own_col"), return_inverse=True)
    other, other_at = np.unique(flat("other_col"), return_inverse=True)
    other_at = other_at.astype(np.int32)
    own_norm, other_norm = np.zeros(len(own)), np.zeros(len(other))
    own_norm[own_at], other_norm[other_at] = flat("own_s"), flat("other_s")
    order = np.argsort(own_at, kind="stable")
    unit, own_at, own_value, other_value = unit[order], own_at[order], flat("own_value")[order], flat("other_value")
    upto, same, width = np.cumsum(reach[unit]), np.searchsorted(other, own), len(other)
    if not halves:  # the place of the column itself, none where these units don't have it
        same = np.where(other[np.minimum(same, width - 1)] == own, same, -1)
    else:
        same = np.searchsorted(other, own, "right")  # the first larger one
    out, a, sums = [], 0, None

    def add(i: np.ndarray, j: np.ndarray, dot: np.ndarray, n: np.ndarray) -> None:
        near = n >= least
        i, j, dot, n = i[near], j[near], dot[near], n[near]
        if best is not None:
            near = _best_of_each(i, best[1](dot, n, own_norm[i], other_norm[j]), best[0])
            i, j, dot, n = i[near], j[near], dot[near], n[near]
        out.append((own[i], other[j], dot, n, own_norm[i], other_norm[j]))

    twice = other_at[1:] == other_at[:-1]
    twice[begin[1:] - 1] = False
    once = not twice.any()  # no row has a column twice
    while a < len(order):
        b = int(np.searchsorted(own_at, own_at[a], "right"))
        if once and upto[b - 1] - (upto[a - 1] if a else 0) >= LONG * (b - a):  # long rows: sums in place, row by row
            sums = sums or (np.zeros(width), np.zeros(width, np.int64))
            for u in range(a, b):
                at = slice(begin[unit[u]], begin[unit[u]] + reach[unit[u]])
                sums[0][other_at[at]] += other_value[at] if others_only else other_value[at] * own_value[u]
                sums[1][other_at[at]] += 1
            me = int(own_at[a])
            found = np.flatnonzero(sums[1])
            kept = found[found >= same[me]] if halves else found[found != same[me]]
            add(np.full(len(kept), me), kept, sums[0][kept], sums[1][kept])
            sums[0][found], sums[1][found] = 0.0, 0
            a = b
            continue
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + at_once, "right"))
        if b < len(order):
            first = int(np.searchsorted(own_at, own_at[b]))
            b = first if first > a else int(np.searchsorted(own_at, own_at[b], "right"))
        many = reach[unit[a:b]]
        at = np.repeat(begin[unit[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        mine, theirs, value = np.repeat(own_at[a:b], many), other_at[at], other_value[at]
        if not others_only:
            value = value * np.repeat(own_value[a:b], many)
        a = b
        kept = theirs >= same[mine] if halves else theirs != same[mine]
        key, value = (mine * width + theirs)[kept], value[kept]
        if not len(key):
            continue
        least_key = int(key.min())
        span = int(key.max()) - least_key + 1
        if span <= DENSE * len(key):  # most columns meet: no sort
            n = np.bincount(key - least_key, minlength=span)
            found = np.flatnonzero(n)
            dot, n, key = np.bincount(key - least_key, value, minlength=span)[found], n[found], found + least_key
        else:
            sort = np.argsort(key)
            key, value = key[sort], value[sort]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            dot, n, key = np.add.reduceat(value, starts), np.diff(np.append(starts, len(key))), key[starts]
        add(*np.divmod(key, width), dot, n)
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 6
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, (id_type, id_type, pa.float64(), pa.int64(), pa.float64(), pa.float64()))], names=["i", "j", "dot", "n", "si", "sj"])


def _best_of_each(i: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest weights of each i, which is sorted, ties to the earlier; zeros are left out."""
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    found = []
    for a, b in zip(starts, np.append(starts[1:], len(i))):
        places = a + np.flatnonzero((weight[a:b] != 0) & ~np.isnan(weight[a:b]))
        if len(places) > k:
            near = weight[places]
            places = places[near >= np.partition(near, len(near) - k)[len(near) - k] - 2e-9]  # of the others none is among the best when rounded
            places = places[np.argsort(-np.round(weight[places], 9), kind="stable")[:k]]
        found.append(places)
    return np.concatenate(found) if found else starts


def cooccurrence(matrix: DataFrame, least: int = 1, mirrored: bool = True) -> DataFrame:
    """i, j, dot, n: sums over common rows; pairs with fewer than `least` of them go."""
    return pair_sums(matrix, least, halves=not mirrored).select("i", "j", "dot", "n")


def mirror(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions, from one pass over the pairs."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")
    return pairs.select(both, *rest).select("x.i", "x.j", *rest)


def top_neighbours(similarity: DataFrame, k: int, key: str = "dst", other: str = "src") -> DataFrame:
    """The k largest weights of each key, ties to the smaller other; zero weights aren't stored."""
    return top_k(similarity.where(F.col("weight") != 0), k, key, other, "weight")


def centred(matrix: DataFrame, key: str) -> DataFrame:
    return matrix.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(key)))


KINDS = ("cosine", "adjusted", "pearson", "asymmetric", "jaccard", "dice", "tversky", "dot", "euclidean")


def similar(matrix: DataFrame, kind: str = "cosine", k: int = 100, shrink: float = 0.0, alpha: float = 0.5, beta: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """src, dst, weight, rank: the k columns most similar to each column `dst`.

    `weights` (row, w) multiplies the products of a row.
    """
    if kind in ("adjusted", "pearson"):
        matrix = centred(matrix, "row" if kind == "adjusted" else "col")
    if kind in ("jaccard", "dice", "tversky"):
        matrix = matrix.withColumn("value", F.lit(1.0))
    left = matrix
    if weights is not None:
        left = matrix.join(weights, "row").select("row", "col", (F.col("value") * F.sqrt("w")).alias("value"))
    norms = matrix.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("s")) if weights is not None else None
    near = pair_sums(left, norms=norms, best=(k, lambda dot, n, si, sj: _weight(kind, shrink, alpha, beta, dot, si, sj, np.sqrt, np.maximum)))
    weight = _weight(kind, shrink, alpha, beta, F.col("dot"), F.col("si"), F.col("sj"), F.sqrt, lambda x, least: F.greatest(x, F.lit(least)))
    return top_neighbours(near.select(F.col("j").alias("src"), F.col("i").alias("dst"), weight.alias("weight")), k)


def similar_groups(matrix: DataFrame, kind: str, k: int, **options) -> DataFrame:
    """As `similar`, for columns of which many are equal, as items by their features are: sums are formed between one of each group of equal columns.

    The k best of a column are among its own group and the k best groups, ordered by weight and smallest member; of a group
    only the k + 1 smallest members can be among them.
    """
    if kind in ("adjusted", "pearson"):
        raise ValueError(f"{kind} is centred over all columns")
    matrix = matrix.where("row is not null and col is not null")
    entry = F.struct("row", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    columns = matrix.groupBy("col").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    named = stored(columns.select("col", F.min("col").over(Window.partitionBy("c")).alias("group")), "groups")
    order = Window.partitionBy("group").orderBy("col")
    members = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy("group").agg(F.array_sort(F.collect_list("col")).alias("members"))
    few = stored(matrix.join(named.where("col = group").select("col"), "col", "left_semi").select("row", "col", "value"), "groups")
    near = similar(few, kind, k, **options).select(F.col("dst").alias("group"), F.col("src").alias("other"), "weight")
    squares = few.groupBy(F.col("col").alias("group")).agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    alike = _weight(kind, options.get("shrink", 0.0), options.get("alpha", 0.5), options.get("beta", 1.0), F.col("s"), F.col("s"), F.col("s"), F.sqrt, lambda x, least: F.greatest(x, F.lit(least)))
    own = squares.select("group", F.col("group").alias("other"), alike.alias("weight"))
    found = near.unionByName(own).join(members.withColumnRenamed("group", "other"), "other").select("group", "weight", F.explode("members").alias("src"))
    found = top_k(found.where(F.col("weight") != 0), k + 1, "group", "src", "weight")  # one more: a column is not its own neighbour
    lists = found.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank", "src", "weight"))).alias("list"))
    own = named.select(F.col("col").alias("dst"), "group").join(lists, "group")
    best = own.select("dst", F.posexplode(F.slice(F.filter("list", lambda x: x["src"] != F.col("dst")), 1, k)).alias("rank", "x"))
    return best.select("x.src", "dst", "x.weight", (F.col("rank") + 1).alias("rank"))


def _weight(kind: str, shrink: float, alpha: float, beta: float, dot, si, sj, sqrt: Callable, most: Callable):
    """Of columns or of numpy arrays, with their functions."""
    tail = shrink + 1e-6
    if kind == "asymmetric":
        return dot / (sqrt(si) ** (2 * alpha) * sqrt(sj) ** (2 * (1 - alpha)) + tail)
    if kind == "jaccard":
        return dot / (si + sj - dot + tail)
    if kind == "dice":
        return dot / (si + sj + tail)
    if kind == "tversky":
        return dot / (dot + (si - dot) * alpha + (sj - dot) * beta + tail)
    if kind == "dot":
        return dot / shrink if shrink else dot
    if kind == "euclidean":
        return 1 / (sqrt(most(si + sj - 2 * dot, 0.0)) + tail)
    return dot / (sqrt(si) * sqrt(sj) + tail)


def tf_idf(matrix: DataFrame) -> DataFrame:
    """sqrt(x) * ln(N / (1 + df)): N rows, df the number of entries of a column."""
    df = matrix.groupBy("col").agg(F.count(F.lit(1)).alias("df"))
    n = matrix.agg(F.count_distinct("row").alias("N"))
    return matrix.join(df, "col").crossJoin(F.broadcast(n)).select("row", "col", (F.sqrt("value") * F.log(F.col("N") / (1 + F.col("df")))).alias("value"))  # one row


def bm25(matrix: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """x * (k1 + 1) / (k1 * length norm + x) * idf, the length being a row's sum."""
    df = matrix.groupBy("col").agg(F.count(F.lit(1)).alias("df"))
    rows = matrix.groupBy("row").agg(F.sum("value").alias("len"))
    whole = rows.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("mean"))
    joined = matrix.join(df, "col").join(rows, "row").crossJoin(F.broadcast(whole))  # one row
    norm = (1 - b) + b * F.col("len") / F.col("mean")
    return joined.select("row", "col", (F.col("value") * (k1 + 1) / (k1 * norm + F.col("value")) * F.log(F.col("N") / (1 + F.col("df")))).alias("value"))


def blend(first: DataFrame, second: DataFrame, share: float, k: int) -> DataFrame:
    """share * first + (1 - share) * second, then the best k."""
    parts = first.select("src", "dst", (F.col("weight") * share).alias("weight")).union(second.select("src", "dst", (F.col("weight") * (1 - share)).alias("weight")))
    return top_neighbours(parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), k)


def feature_weighted(features: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Sum over common features (item_id, feature) of their weight w, the best k."""
    matrix = features.join(weights, "feature").select(F.col("feature").alias("row"), F.col("item_id").alias("col"), F.sqrt("w").alias("value"))
    return similar_groups(matrix, "dot", k)


def overlap(content: DataFrame, collaborative: DataFrame) -> DataFrame:
    """One row: content pairs, and those of them that have a collaborative weight."""
    both = content.select("src", "dst").join(collaborative.select("src", "dst", F.lit(1).alias("_c")), ["src", "dst"], "left")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count("_c").alias("shared"), (F.count("_c") / F.count(F.lit(1))).alias("share"))


#: Vectors of a block, and blocks at most, by falling length.
VECTORS, MOST_BLOCKS = 4096, 65_536


def largest_products(queries: DataFrame, vectors: DataFrame, k: int, block: int = VECTORS) -> DataFrame:
    """query, id, product: for each of `queries` (id, vec) the k largest dot products with `vectors` (id, vec), itself left out, ties to the smaller id; rounded to nine places for the order.

    Vectors are dealt into blocks by falling length. Every query meets the block
    of the longest first; the k-th best product there, over the query's length,
    is what a vector must at least be long, so that all blocks of shorter
    vectors are skipped (Cauchy-Schwarz). Only the others are opened, with
    slices of the queries that need them.
    """
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, spark = vectors.count(), vectors.sparkSession
    block = max(block, -(-n // MOST_BLOCKS))
    sorted_ = places(vectors.select("id", "vec", length.alias("norm")), F.col("norm").desc(), F.col("id").asc())
    dealt = stored(sorted_.select("id", "vec", "norm", F.expr(f"cast(place div {block} as int)").alias("block")), "lengths")
    none = spark.createDataFrame([], "query long, id long, product double")
    if not n:
        return none
    longest = np.array([r["most"] for r in dealt.groupBy("block").agg(F.max("norm").alias("most")).orderBy("block").collect()])  # a number for each block
    head = dealt.where("block = 0").select("id", "vec").toPandas()  # one block
    first = spark.sparkContext.broadcast((head["id"].to_numpy(), np.stack(head["vec"].to_list()), longest))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, longest = first.value
        for pdf in batches:
            if not len(pdf):
                continue
            q = np.stack(pdf["vec"].to_list())
            found = _best_products(pdf["id"].to_numpy(), q, ids, x, k)
            least = np.array([p[-1] if len(p) == k else -np.inf for _, p in found])
            reach = np.linalg.norm(q, axis=1)[:, None] * longest >= least[:, None] - 1e-8 * (1 + np.abs(least[:, None]))
            yield pd.DataFrame({"query": pdf["id"], "vec": pdf["vec"], "last": (reach.sum(axis=1) - 1).clip(min=0), "ids": [i for i, _ in found], "products": [p for _, p in found]})

    met = stored(queries.select("id", "vec").mapInPandas(opened, "query long, vec array<double>, last int, ids array<long>, products array<double>"), "met")
    near = met.select("query", F.explode(F.arrays_zip("ids", "products")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.products").alias("product"))
    wanted = met.where("last > 0").select("query", "vec", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("block"))
    slices = stored(wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices")), "slices")  # a row for each block
    if slices.isEmpty():
        return _k_best(near, k)
    ask = wanted.join(F.broadcast(slices), "block").select("block", F.pmod(F.xxhash64("query"), "slices").cast("int").alias("slice"), "query", "vec")
    told = dealt.join(F.broadcast(slices), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", F.col("vec").alias("other"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": np.array([], np.int64), "id": np.array([], np.int64), "product": np.array([], float)})
        found = _best_products(a["query"].to_numpy(), np.stack(a["vec"].to_list()), b["id"].to_numpy(), np.stack(b["other"].to_list()), k)
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), [len(i) for i, _ in found]), "id": np.concatenate([i for i, _ in found]), "product": np.concatenate([p for _, p in found])})

    more = ask.groupBy("block", "slice").cogroup(told.groupBy("block", "slice")).applyInPandas(product, "query long, id long, product double")
    return _k_best(near.unionByName(more), k)


def _best_products(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the ids and products of its k largest, its own id left out, largest first."""
    out = []
    for a in range(0, len(q), 256):
        for me, s in zip(queries[a : a + 256], q[a : a + 256] @ x.T):
            s[ids == me] = -np.inf
            least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
            near = np.flatnonzero((s >= least - 1e-8) & (s > -np.inf))
            near = near[np.lexsort((ids[near], -np.round(s[near], 9)))[:k]]
            out.append((ids[near], s[near]))
    return out


def _k_best(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows, k, "query", "id", "product").select("query", "id", "product")


def of_factors(factors: DataFrame, k: int, block: int = VECTORS) -> DataFrame:
    """src, dst, weight, rank: the k largest dot products of each vector (id, vec), self excluded; zero weights aren't stored."""
    found = largest_products(factors, factors, k, block)
    return top_neighbours(found.select(F.col("query").alias("dst"), F.col("id").alias("src"), F.col("product").alias("weight")), k)
