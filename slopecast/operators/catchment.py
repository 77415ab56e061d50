"""Sums carried down a tree of any depth, in a logarithmic number of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, reused

BLOCK = 1 << 16  # nodes that lie side by side by number and are summed up in one go


def _further(ptr: DataFrame) -> DataFrame:
    """``ptr`` (node, down) with the nodes two, three and four steps below as ``d2``, ``d3``, ``d4``."""
    hop = ptr.where(F.col("down").isNotNull())

    def below(df: DataFrame, of: str, out: str, table: DataFrame, to: str) -> DataFrame:
        return df.join(table.select(F.col("node").alias(of), F.col(to).alias(out)), of, "left")

    two = durable(below(ptr, "down", "d2", hop, "down").select("node", "down", "d2"))
    last = two.where(F.col("d2").isNotNull())
    return below(below(two, "d2", "d3", hop, "down"), "d2", "d4", last, "d2").select("node", "down", "d2", "d3", "d4")


def _by_rounds(ptr: DataFrame, values: DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Totals down the pointers ``ptr`` (node, down), all of which lead to a node or are NULL.

    Round k holds each node's total over the nodes fewer than 4^k steps upstream; adding
    every node's total to the nodes 4^k, 2 * 4^k and 3 * 4^k steps below it makes the reach four
    times as long. A tree of depth d takes log4(d) rounds of one join and one combining
    aggregation of the values, each linear in them: the ancestor/descendant pairs are never
    written out. What has to be found out about the tree itself, one row per node, is found
    beside the values and never multiplied by the keys.

    The pointers are checkpointed every round, the values every three, so plans stay short.
    """
    ptr = durable(ptr)
    acc = values.select("node", *keys, *sums)
    most = max(1, ptr.count()).bit_length()  # no path is longer than the node count
    rounds = 0
    while not ptr.where(F.col("down").isNotNull()).isEmpty():
        rounds += 1
        if 2 * (rounds - 1) > most:
            raise ValueError("the drainage graph has a cycle")
        if rounds % 3 == 0:
            acc = durable(acc)
        far = durable(_further(ptr))
        moving = far.where(F.col("down").isNotNull())
        targets = F.filter(F.array("node", "down", "d2", "d3"), lambda x: x.isNotNull())
        acc = (
            acc.join(moving, "node", "left")
            .select(F.explode(targets).alias("node"), *keys, *sums)
            .groupBy("node", *keys)
            .agg(*[F.sum(s).alias(s) for s in sums])
        )
        ptr = moving.select("node", F.col("d4").alias("down"))
    return acc


def _sum_down(p: np.ndarray, cols: list[np.ndarray]) -> list[np.ndarray]:
    """Totals of each column over a row and all rows upstream; ``p``: the row below, -1 at an end."""
    p, out = p.copy(), [c.copy() for c in cols]
    while len(up := np.flatnonzero(p >= 0)):
        for k, c in enumerate(out):
            more = np.zeros_like(c)
            np.add.at(more, p[up], c[up])
            out[k] = c + more
        p[up] = p[p[up]]
    return out


def _ends(p: np.ndarray) -> np.ndarray:
    """The last row downstream of each row, -1 for rows that lead into a loop."""
    here = np.arange(len(p))
    q = np.where(p >= 0, p, here)
    for _ in range(len(p).bit_length()):
        q = q[q]
    return np.where(p[q] < 0, q, -1)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column without nulls for summing; whole numbers that could overflow become Python's own, which never do."""
    x = column.to_numpy()
    return x.astype(object) if x.dtype.kind == "i" and np.abs(x.astype(np.float64)).sum() >= 2.0**62 else x


def _per_block(df: DataFrame, ddl: str, block: str | None, work: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """What ``work`` makes of each block: rows of one ``block``, or at most BLOCK rows that stand side by side."""
    at = None if block is None else df.columns.index(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while b.num_rows:
                if at is None:
                    n = min(b.num_rows, BLOCK - rows)
                else:
                    cur = held[0].column(at)[0] if held else b.column(at)[0]
                    n = pc.sum(pc.equal(b.column(at), cur)).as_py()  # rows arrive sorted by block
                if n:
                    held.append(b.slice(0, n))
                    rows += n
                    b = b.slice(n)
                if rows == BLOCK or b.num_rows:
                    yield work(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            yield work(pa.Table.from_batches(held))

    return df.mapInArrow(run, ddl)


def _contracted(ptr: DataFrame, values: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The totals of :func:`_by_rounds` for values without keys, whose rounds go over the links between blocks alone.

    Nodes are ranged by number and cut into blocks. A block sums up what lies inside it and
    tells where each node's path leaves it; the nodes before which a path leaves are a tree of their own,
    usually much smaller, whose totals enter the blocks again.
    """
    counted = [f"_seen_{c}" for c in sums]
    own = values.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums], *[F.count(c).alias(f"_seen_{c}") for c in sums])
    kinds = {c: own.schema[c].dataType for c in sums}
    cols = ["_rows", *sums, *counted]
    ddl = ", ".join(f"{c} {kinds[c].simpleString() if c in kinds else 'long'}" for c in cols)
    arrow = {c: pa.float64() if kinds.get(c) == T.DoubleType() else pa.int64() for c in cols}
    table = ptr.where("node is not null").join(own.where("node is not null"), "node", "full").select(
        F.col("node").cast("long"), F.col("down").cast("long"), *[F.coalesce(F.col(c), F.lit(0).cast(own.schema[c].dataType)).alias(c) for c in cols]
    )

    def rows_below(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, down = t["node"].to_numpy(), t["down"].fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(node, down), len(node) - 1)
        return node, np.where((node[at] == down) & t["down"].is_valid().to_numpy(), at, -1)

    def inside(t: pa.Table) -> pa.RecordBatch:
        node, p = rows_below(t)
        end = _ends(p)
        stuck = end < 0
        own_cols = [_numbers(t[c]) for c in cols]
        totals = _sum_down(np.where(stuck, -1, p), own_cols)
        leave = p < 0  # only these rows' totals are needed outside
        out = [pa.array(node), t["down"].combine_chunks(), pa.array(np.full(len(node), node[0])), pa.array(np.where(stuck, 0, node[end]), mask=stuck)]
        out += [t[c].combine_chunks() for c in cols]
        out += [pa.array(x, arrow[c], mask=~leave) for c, x in zip(cols, totals, strict=True)]
        return pa.RecordBatch.from_arrays(out, names=names)

    names = ["node", "down", "block", "end", *cols, *[f"_in{c}" for c in cols]]
    ranged = table.repartitionByRange("node").sortWithinPartitions("node")
    blocks = reused(_per_block(ranged, f"node long, down long, block long, end long, {ddl}, " + ", ".join(f"_in{x}" for x in ddl.split(", ")), None, inside), "blocks")
    if not blocks.where("end is null").isEmpty():
        raise ValueError("the drainage graph has a cycle")
    leaving = blocks.where("end = node").select("node", "down", *[F.col(f"_in{c}").alias(c) for c in cols])
    links = leaving.select("node", F.col("down").alias("_to")).join(blocks.select(F.col("node").alias("_to"), F.col("end").alias("down")), "_to", "left")
    between = reused(_by_rounds(links.select("node", "down"), leaving.select("node", *cols), cols), "between")
    entering = between.join(leaving.select("node", "down").where("down is not null"), "node").groupBy(F.col("down").alias("node")).agg(*[F.sum(c).alias(f"_x{c}") for c in cols])
    raised = blocks.select("node", "down", "block", *cols).join(entering, "node", "left").select(
        "node", "down", "block", *[(F.col(c) + F.coalesce(F.col(f"_x{c}"), F.lit(0).cast(own.schema[c].dataType))).alias(c) for c in cols]
    )

    def whole(t: pa.Table) -> pa.RecordBatch:
        node, p = rows_below(t)
        totals = _sum_down(p, [_numbers(t[c]) for c in cols])
        return pa.RecordBatch.from_arrays([pa.array(node), *[pa.array(x, arrow[c]) for c, x in zip(cols, totals, strict=True)]], names=["node", *cols])

    total = _per_block(raised.repartition("block").sortWithinPartitions("block", "node"), f"node long, {ddl}", "block", whole).where("_rows > 0")
    kind = own.schema["node"].dataType
    found = total.select(F.col("node").cast(kind), *[F.when(F.col(f"_seen_{c}") > 0, F.col(c)).alias(c) for c in sums])
    return found.unionByName(own.where("node is null").select("node", *sums))


def accumulate(edges: DataFrame, values: DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Totals of ``sums`` over each node and everything upstream of it, per extra key.

    ``edges``: (node, down), one row per node, NULL or a negative ``down`` at an outlet. A
    ``down`` that is no node itself (a clipped basin set) is an outlet, too. Reaches grow in
    rounds (:func:`_by_rounds`); without keys, stretches of neighbouring numbers are summed up before them.
    """
    known = edges.select(F.col("node").alias("down"), F.lit(True).alias("_known"))
    # as many rows on both sides, which computed edges are often estimated far below: so none is broadcast
    ptr = edges.select("node", "down").hint("merge").join(known, "down", "left")
    ptr = ptr.select("node", F.when((F.col("down") >= 0) & F.col("_known"), F.col("down")).alias("down"))
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = [values.schema[c].dataType for c in sums]
    if not keys and isinstance(values.schema["node"].dataType, integral) and all(isinstance(k, (*integral, T.FloatType, T.DoubleType)) for k in kinds):
        return _contracted(ptr, values, sums)
    return _by_rounds(ptr, values, sums, keys)


MICRO = 1_000_000  # sums are carried in whole millionths, so that their order cannot change a result


def _micros(c: Column) -> Column:
    return F.round(c * MICRO).cast("long")


def upstream_mean(basins: DataFrame, values: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Area-weighted means over each basin and its upstream, plus the area they cover.

    ``basins``: (basin, next_down, sub_area); ``values``: (basin, *keys, *names). Products and
    areas are summed as whole millionths, which is exact, and divided once; a sum beyond the
    range of a long raises an error. A basin with nothing upstream has no order of its sum, so its
    mean is the plain product over its area, not rounded to millionths.
    """
    edges = basins.select(F.col("basin").alias("node"), F.col("next_down").alias("down"))
    weighted = values.join(basins.select("basin", "sub_area"), "basin").select(
        F.col("basin").alias("node"), *keys, _micros(F.col("sub_area")).alias("up_area"),
        *[_micros(F.col(n) * F.col("sub_area")).alias(n) for n in names],
        *[(F.col(n) * F.col("sub_area") / F.nullif(F.col("sub_area"), F.lit(0.0))).alias(f"_own_{n}") for n in names], F.lit(1).cast("long").alias("_n"),
    )
    tot = accumulate(edges, weighted, ["up_area", *names, *[f"_own_{n}" for n in names], "_n"], keys)
    alone = (F.col("_n") == 1) & (F.col("up_area") > 0)
    return tot.select(
        F.col("node").alias("basin"), *keys, (F.col("up_area") / MICRO).alias("up_area"),
        *[F.when(alone, F.col(f"_own_{n}")).otherwise(F.col(n) / F.greatest(F.col("up_area"), F.lit(1))).alias(n) for n in names],
    )


def order_violations(basins: DataFrame, area: str) -> DataFrame:
    """Count basins whose downstream neighbour does not drain a larger area."""
    down = basins.select(F.col("basin").alias("next_down"), F.col(area).alias("_down_area"))
    j = basins.join(down, "next_down")
    return j.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("_down_area") <= F.col(area)).alias("violations"))
