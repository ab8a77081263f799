"""Near copies among embeddings by spherical k-means.

Centres are learnt from a bounded sample. Every vector belongs to the cell of
its nearest centre, and visits the other cells in which a vector that is near
enough may be: where x and y have a cosine of t at least, x lies in cell a and y
in cell b, the vector x - y is at most sqrt(2 - 2t) long, so that one of the two
is within half of that, times the distance of the centres, of the plane between
the cells. Hence a pair meets in the cell of one of its vectors, always, and is
counted in one cell only. `reach` below 1 shrinks that distance: fewer visits,
at the risk of pairs that straddle a plane.

Inside a cell, blocks of its members are compared with blocks of members and of
visitors by matrix products. A task returns the number of links of its vectors
and a spanning forest of the links, never the pairs. Equal vectors are one vector
with a number of copies from the start, so that copies aren't compared. One
representative of each group, its smallest vec_id, is kept.

Cases: vectors that are null, zero, empty or hold null or non-finite components,
and rows without a vec_id, link with nothing and are kept; vectors of different
lengths don't link; rows that repeat a vec_id are rows of their own, which count
as other vectors of each other; a row without a vec_id has a null component_id;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, stored
from aislecraft.llm.graph import components
from aislecraft.llm.vectors import is_finite, unit

THRESHOLD, REACH = 0.9, 1.0
#: Vectors that the centres are learnt from, at most; rounds of k-means; cells, at least and at most.
SAMPLE, ROUNDS, CELLS = 20_000, 10, (4, 4096)
#: Members or visitors of a cell that a task compares at a time.
BLOCK = 2048
#: Vectors that a round of cells sends to its tasks, or so many times all vectors where that is more.
SENT, TIMES = 2_000_000, 2
#: Cosines so near to the threshold are worked out again, term by term.
CLOSE = 1e-9


def cells_for(n: int) -> int:
    """An eighth of the root of n: with fewer cells vectors have fewer copies, with more they meet fewer others."""
    return min(CELLS[1], max(CELLS[0], round(n**0.5 / 8)))


def padded(column, width: int) -> np.ndarray:
    """Arrays of any length as unit rows of one width; zeros at the end change no cosine."""
    out = np.zeros((len(column), width))
    for row, x in zip(out, column):
        row[: len(x)] = x
    return unit(out) if len(out) else out


def centres(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means over unit rows: at most `cells` unit centres, none without members in the last round."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1)
        c = sums[length > 1e-9] / length[length > 1e-9, None]
    return c


def visited(s: np.ndarray, apart: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each row of cosines with the centres: its cell, and the other cells whose plane is within `margin`."""
    home = s.argmax(axis=1)
    far = s[np.arange(len(s)), home][:, None] - s
    near = far <= margin * apart[home] + 1e-9
    near[np.arange(len(s)), home] = False
    return home, [np.flatnonzero(row).astype(np.int32) for row in near]


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that connect whatever the true entries of a matrix connect, fewer than rows and columns together."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    small = linked[np.ix_(rows, columns)]
    new_row, new_column, a, b = np.ones(len(rows), bool), np.ones(len(columns), bool), [], []
    for start in range(len(rows)):
        queue, new_row[start] = [start] if new_row[start] else [], False
        while queue:
            r = queue.pop()
            for c in np.flatnonzero(small[r] & new_column):
                a.append(r)
                b.append(c)
                new_column[c] = False
                for other in np.flatnonzero(small[:, c] & new_row):
                    a.append(other)
                    b.append(c)
                    new_row[other] = False
                    queue.append(other)
    return rows[np.array(a, int)], columns[np.array(b, int)]


def compared(cell: int, same: bool, left: pd.DataFrame, right: pd.DataFrame, width: int, threshold: float) -> pd.DataFrame:
    """(a, b, n): links n of the vectors a (b is -1), and edges a-b, of a block of the cell's members and one of members or visitors."""
    x, y = padded(left["x"], width), padded(right["x"], width)
    s = x @ y.T
    close = np.argwhere(np.abs(s - threshold) <= CLOSE)
    for i, j in close:
        s[i, j] = (x[i] * y[j]).sum()
    linked = s >= threshold
    ids, others, home = left["node"].to_numpy(), right["node"].to_numpy(), right["home"].to_numpy()
    linked &= left["width"].to_numpy()[:, None] == right["width"].to_numpy()
    if same:  # a block of members with itself
        linked &= ids[:, None] < others
    for h in np.unique(home[(home > cell) & linked.any(axis=0)]):  # those pairs have met in the visitor's cell where the member visits it
        back = np.array([h in v for v in left["visits"]])
        linked[np.ix_(back, home == h)] = False
    i, j = forest(linked)
    n_left, n_right = linked @ right["copies"].to_numpy(), left["copies"].to_numpy() @ linked
    counts = pd.DataFrame({"a": np.concatenate((ids[n_left > 0], others[n_right > 0])), "b": -1, "n": np.concatenate((n_left[n_left > 0], n_right[n_right > 0]))})
    return pd.concat((counts, pd.DataFrame({"a": ids[i], "b": others[j], "n": 0})))[["a", "b", "n"]].astype(np.int64)


def assigned(nodes: DataFrame, n: int, width: int, threshold: float, reach: float) -> DataFrame:
    """The columns of `nodes`, home and visits of every different vector."""
    sample = nodes.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()
    c = centres(padded([r["x"] for r in sample], width), cells_for(n))
    spread = nodes.sparkSession.sparkContext.broadcast(c)  # at most CELLS centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = spread.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        for batch in batches:
            if batch.num_rows:
                home, visits = visited(padded(batch.column(1).to_numpy(zero_copy_only=False), width) @ c.T, apart, reach * ((1 - threshold) / 2) ** 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "home", "visits"])

    kept = [c for c in nodes.columns if c not in ("node", "x")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select("node", "x", *kept).schema)
    return nodes.select("node", "x", *kept).mapInArrow(run, f"{fields}, home int, visits array<int>")


def linked(placed: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, n) of `compared` over all cells, blocks of members with blocks of members and visitors; as many cells at once as SENT allows, so that the disk holds one round's vectors."""
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("v"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    counted = members.join(visitors, "cell", "left").withColumn("v", F.coalesce("v", F.lit(0))).select("cell", "m", "v", blocks("m").alias("inner"), blocks("v").alias("outer"))
    cells = stored(counted, "cells")  # a row for each centre
    sent = cells.orderBy("cell").selectExpr("cell", "m", "m * (inner + outer) + v * inner AS sent").collect()
    round_ = (np.cumsum([r["sent"] for r in sent]) - 1) // max(SENT, TIMES * sum(r["m"] for r in sent))
    rounds = [[r["cell"] for r, k in zip(sent, round_) if k == one] for one in np.unique(round_)]
    if len(rounds) == 1:
        return _linked(placed, cells, width, threshold)
    out = None
    for some in rounds:  # of neighbouring numbers
        one = stored(_linked(placed, cells.where(F.col("cell").between(some[0], some[-1])), width, threshold), "links")
        out = one if out is None else out.unionByName(one)
    return out


def _linked(placed: DataFrame, cells: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of some cells (cell, inner, outer)."""
    cells = cells.select("cell", "inner", "outer")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda a, b: F.explode(F.sequence(a, b))
    here = placed.withColumn("cell", F.col("home")).join(F.broadcast(cells), "cell").withColumn("i", block("inner"))
    left = here.select("*", every(F.col("i"), F.col("inner") + F.col("outer") - 1).alias("j")).select("cell", "i", "j", "node", "x", "width", "copies", "visits")
    again = placed.sparkSession.read.schema(placed.schema).parquet(placed._stored_at)  # columns of its own for the other side
    inside = again.withColumn("cell", F.col("home")).join(F.broadcast(cells), "cell").withColumn("j", block("inner"))
    inside = inside.select("*", every(F.lit(0), F.col("j")).alias("i"))
    there = again.select("*", F.explode("visits").alias("cell")).join(F.broadcast(cells), "cell").withColumn("j", block("outer") + F.col("inner"))
    there = there.select("*", every(F.lit(0), F.col("inner") - 1).alias("i"))
    columns = ["cell", "i", "j", "node", "x", "width", "copies", "home"]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({k: np.array([], np.int64) for k in "abn"})
        return compared(int(key[0]), key[1] == key[2], a, b, width, threshold)

    keys = ["cell", "i", "j"]
    pairs = left.groupBy(*keys).cogroup(inside.select(*columns).union(there.select(*columns)).groupBy(*keys))
    return pairs.applyInPandas(run, "a long, b long, n long")


def groups(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors` (vec_id, embedding)."""
    id_, x = F.col("vec_id").cast("long"), F.col("embedding")
    whole = x.cast("array<double>")
    takes_part = F.coalesce(id_.isNotNull() & is_finite(whole) & F.exists(whole, lambda v: v != 0), F.lit(False))
    plain = F.when(takes_part, F.transform(x, lambda v: v + F.lit(0).cast("tinyint")))  # a zero has no sign
    rows = vectors.select(id_.alias("vec_id"), plain.alias("x"))
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    key = [F.xxhash64("x").alias("key1"), F.xxhash64(F.lit(1), "x").alias("key2")]
    nodes = rows.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "x", F.size("x").alias("width"), "copies", "least", *key), "vectors")
    n, width = nodes.agg(F.count(F.lit(1)), F.max("width")).first()
    if not n:
        discard(nodes)
        return alone(rows)
    placed = stored(assigned(nodes, n, width, threshold, reach), "cells")
    discard(nodes)
    found = stored(linked(placed, width, threshold), "links")
    labels = components(found.where("b >= 0").select("a", "b"))
    n_links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of_node = placed.select("node", "copies", "least", "key1", "key2").join(n_links, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    of_node = stored(of_node, "nodes")
    discard(placed, found, labels)
    smallest = of_node.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("smallest"))
    of_node = of_node.join(smallest, "label", "left").select("key1", "key2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    found_rows = rows.where("x IS NOT NULL").select("vec_id", *key).join(of_node, ["key1", "key2"])
    return found_rows.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone(rows.where("x IS NULL")))
