"""A Merkle manifest of a dataset, with leaf coordinates from bitmap ranks instead of a sort.

Each group of rows (here: a language) is a tree whose leaves ascend by id. Ids are gathered as
bitmaps of 64-bit words, of which only words with a bit stand in a table; ``bit_or`` merges them
on the map side and across tasks. Directories hold how many rows lie before a word in its block,
before the block in its superblock, and so on for the whole 64-bit range, so a leaf's place is
a few sums and the popcount of the bits below its own. No window spans more than 2^16 entries.

The tree then falls into blocks of 8^3 places. A task puts the digests of a block into slots
by their place and reduces three levels at once; what a block yields is one node of the next
pass. On the way back every block hands the path above it to its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..session import reused

FANOUT = 8
LEVELS = 3  # levels that one pass over blocks reduces
DIRECTORY = (10, 16, 16, 16)  # bits of a word's number that each directory level takes up: 58 in all
NULL_WORD = -(1 << 57) - 1  # the word of a null key, before all others
STRING_BYTES = 7  # bytes of a string compared at once


# --- ranks


def _directories(words: DataFrame, by: list[str]) -> DataFrame:
    """``words`` (by, w, n) with ``base``, the rows of its group in smaller words."""
    level = words.select(*by, "w", "n")
    tables = []
    for bits in DIRECTORY:
        level = level.withColumn("up", F.shiftright("w", bits))
        before = F.sum("n").over(W.partitionBy(*by, "up").orderBy("w").rowsBetween(W.unboundedPreceding, -1))
        tables.append(level.select(*by, "w", "up", F.coalesce(before, F.lit(0)).alias("base")))
        level = level.groupBy(*by, F.col("up").alias("w")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy(*by).orderBy("w").rowsBetween(W.unboundedPreceding, -1))
    found = level.select(*by, "w", F.coalesce(before, F.lit(0)).alias("base"))  # two entries at most: one for null keys
    for t in reversed(tables):
        above = found.select(*by, F.col("w").alias("up"), F.col("base").alias("above"))
        found = t.join(above, [*by, "up"]).select(*by, "w", (F.col("base") + F.col("above")).alias("base"))
    return words.join(found, [*by, "w"])


def ranks(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``: how many rows of the same ``by`` come before it in the order of ``keys``.

    ``keys`` are 64-bit integers, compared in turn, null before all. ``by`` columns hold no null.
    A further key is looked at only for rows that tie on those before it. Rows that tie on all
    keys are numbered in an order that a window chooses, in groups of such rows alone.
    """
    if not keys:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*by)) - F.lit(1).cast("long"))
    key = F.col(keys[0])
    w = F.coalesce(F.shiftright(key, 6), F.lit(NULL_WORD)).alias("w")
    at = F.coalesce(key.bitwiseAND(63), F.lit(0)).cast("int").alias("_at")
    placed = rows.select("*", w, at)
    gathered = placed.groupBy(*by, "w").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("bits"), F.count("*").alias("n"))
    words = reused(_directories(reused(gathered, "bitmap"), by), "ranked-words")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, _at))")
    tied = words.where(F.col("n") > F.bit_count("bits"))
    found = placed.join(words, [*by, "w"])
    if tied.isEmpty():
        return found.withColumn("rank", F.col("base") + below).select(*rows.columns, "rank")
    # words in which a key repeats are counted key by key, 64 at most
    alone = found.where(F.col("n") == F.bit_count("bits")).withColumn("rank", F.col("base") + below).select(*rows.columns, "rank")
    some = placed.join(tied.select(*by, "w", "base"), [*by, "w"])
    each = some.groupBy(*by, "w", "_at").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy(*by, "w").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = reused(some.join(each.withColumn("_before", before), [*by, "w", "_at"]).withColumn("_first", F.col("base") + F.col("_before")), "tied")
    single = some.where("_m = 1").withColumn("rank", F.col("_first")).select(*rows.columns, "rank")
    word, at, first = (f"{c}_{len(keys)}" for c in ("_w", "_at", "_first"))
    again = some.where("_m > 1").select(*rows.columns, F.col("w").alias(word), F.col("_at").alias(at), F.col("_first").alias(first))
    inner = ranks(again, [*by, word, at], keys[1:])
    inner = inner.withColumn("rank", F.col("rank") + F.col(first)).select(*rows.columns, "rank")
    return alone.unionByName(single).unionByName(inner)


def string_keys(column: str, size: int) -> list[Column]:
    """Integers that order strings of at most ``size`` bytes bytewise, null first; a prefix comes before the longer one."""
    raw = F.hex(F.encode(column, "UTF-8"))
    step = 2 * STRING_BYTES
    chunks = [F.conv(F.rpad(F.substring(raw, 1 + k * step, step), step, "0"), 16, 10).cast("long") for k in range(-(-size // STRING_BYTES))]
    return [*chunks, F.octet_length(column).cast("long")]


# --- trees


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(column: str) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = F.col(f"`{column}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str], change: dict[str, Column] | None = None) -> Column:
    fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) if (c := (change or {}).get(n)) is not None else field(n) for n in columns]
    return F.sha2(F.concat(*fields), 256)


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The node lists of a block, level by level from its leaves."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([digest(now[i : i + FANOUT]) for i in range(0, len(now), FANOUT)])
    return out


def depth(n: Column) -> Column:
    """Reductions that ``n`` nodes need until one is left."""
    return F.expr("aggregate(sequence(1, 22), named_struct('n', cast(_n as long), 'd', 0), (a, k) -> if(a.n > 1, named_struct('n', (a.n + 7) div 8, 'd', a.d + 1), a), a -> a.d)".replace("_n", n))


def _slots(block: pd.DataFrame, span: int) -> list[str]:
    """The block's digests, each in the slot of its place."""
    slots = np.empty(len(block), object)
    slots[block["rank"].to_numpy() % span] = block["node"].to_numpy()
    return slots.tolist()


NODES = "tree string, depth int, rank long, node string"


def _block(levels: int) -> Column:
    return F.expr(f"rank div {FANOUT**levels}").alias("block")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """One pass: every block of nodes (tree, depth left, rank, node) becomes one node."""
    span = FANOUT**levels

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        left = int(block["depth"].iloc[0])
        top = _reduced(_slots(block, span), min(left, levels))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "depth": [max(0, left - levels)], "rank": [key[1]], "node": [top]})

    return nodes.groupBy("tree", _block(levels)).applyInPandas(run, NODES)


PATHS = "tree string, rank long, node string, lefts array<string>, rights array<string>"


def path_of(nodes_of: list[list[str]], slot: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a leaf's ancestors in their runs, level by level."""
    lefts, rights = [], []
    for nodes in nodes_of[:-1]:
        run = slot - slot % FANOUT
        lefts.append("".join(nodes[run:slot]))
        rights.append("".join(nodes[slot + 1 : run + FANOUT]))
        slot //= FANOUT
    return lefts, rights


def _down(nodes: DataFrame, above: DataFrame | None, levels: int) -> DataFrame:
    """Paths from the nodes of a pass to the root of their tree, given those of the next pass's nodes."""
    span = FANOUT**levels

    def paths(block: pd.DataFrame, lefts: list, rights: list) -> pd.DataFrame:
        nodes_of = _reduced(_slots(block, span), min(int(block["depth"].iloc[0]), levels))
        own = [path_of(nodes_of, int(r) % span) for r in block["rank"]]
        out = block[["tree", "rank", "node"]].copy()
        out["lefts"], out["rights"] = [p + lefts for p, _ in own], [q + rights for _, q in own]
        return out

    def alone(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return paths(block, [], [])

    def met(key: tuple, block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        return paths(block, list(up["lefts"].iloc[0]), list(up["rights"].iloc[0]))

    by_block = nodes.groupBy("tree", _block(levels))
    if above is None:
        return by_block.applyInPandas(alone, PATHS)
    return by_block.cogroup(above.groupBy("tree", F.col("rank").alias("block"))).applyInPandas(met, PATHS)


@dataclass(frozen=True)
class Forest:
    """Nodes of every pass over a set of trees; the last holds one node per tree."""

    passes: list[DataFrame]
    levels: int

    @property
    def tops(self) -> DataFrame:
        return self.passes[-1].select("tree", F.col("node").alias("top"))

    def paths_above_blocks(self) -> DataFrame | None:
        """Paths of the nodes of pass one, which are the blocks of leaves; null if leaves are a single pass's tops."""
        found = None
        for nodes in reversed(self.passes[1:]):
            found = _down(nodes, found, self.levels)
        return found


def grow(leaves: DataFrame, levels: int) -> Forest:
    """All passes over ``leaves`` (tree, depth, rank, node), each written to the shared folder."""
    passes = [leaves]
    while True:
        passes.append(reused(_up(passes[-1], levels), "nodes"))
        if passes[-1].where("depth > 0").isEmpty():
            return Forest(passes, levels)


RESULT = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "tree string, rank long"
)


def fold(node: str, lefts: Iterable[str], rights: Iterable[str]) -> str:
    """The root that a node and the siblings of its path give."""
    for a, b in zip(lefts, rights, strict=True):
        node = digest((a, node, b))
    return node


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, rank, depth, node (the leaf), doc_id and, where given, claim; ``paths``: one row per block of leaves."""

    leaves: DataFrame
    paths: DataFrame
    trees: DataFrame
    levels: int

    def proofs(self) -> DataFrame:
        """Per row: leaf, subroot, root, proof, and the root folded from ``claim`` and the leaf's siblings."""
        levels, span = self.levels, FANOUT**self.levels

        def run(key: tuple, block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            u = up.iloc[0]
            nodes_of = _reduced(_slots(block, span), min(int(block["depth"].iloc[0]), levels))
            tail_l, tail_r = list(u["lefts"]), list(u["rights"])
            rows = []
            for doc, node, claim, rank in zip(block["doc_id"], block["node"], block["claim"], block["rank"], strict=True):
                lefts, rights = path_of(nodes_of, int(rank) % span)
                lefts, rights = lefts + tail_l, rights + tail_r
                siblings = digest(x for pair in zip(lefts, rights, strict=True) for x in pair)
                folded = fold(claim, lefts, rights)
                rows.append((doc, node, u["top"], u["root"], siblings, folded, folded == u["root"], key[0], rank))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

        # ids travel as text: beside a null, pandas would make them floating-point numbers
        by_block = self.leaves.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", _block(levels))
        return by_block.cogroup(self.paths.groupBy("tree", "block")).applyInPandas(run, RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(
    df: DataFrame, doc_id: str, group: str, columns: list[str], claim: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS
) -> Manifest:
    """The Merkle forest over the rows of ``df``: one tree per ``group`` value, and a tree over their tops.

    ``columns`` enter a leaf in their order. Leaves ascend by ``doc_id`` (an integer; null first);
    of equal ids, by their digest; wholly equal rows stand side by side. Groups ascend bytewise,
    null first. ``claim`` changes columns of the rows where ``when`` holds: what a proof is asked
    to verify, never what the tree is built of. Every row is one leaf, repeated rows too; a tree
    of one leaf has that leaf as its top; an empty table has no leaves, trees or root. Columns
    that are not named are ignored.
    """
    own = leaf(columns)
    claimed = own if claim is None else F.when(F.coalesce(when, F.lit(False)), leaf(columns, claim)).otherwise(own)
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    table = reused(df.select(tree.alias("tree"), F.col(doc_id).cast("long").alias("doc_id"), own.alias("node"), claimed.alias("claim")), "leaves")
    table = table.withColumn("_tie", F.conv(F.substring("node", 1, 15), 16, 10).cast("long"))
    sizes = reused(table.groupBy("tree").agg(F.count("*").alias("_n")), "sizes")
    ranked = ranks(table, ["tree"], ["doc_id", "_tie"]).drop("_tie")
    leaves = reused(ranked.join(sizes.select("tree", depth("_n").alias("depth")), "tree"), "ranked-leaves")
    forest = grow(leaves.select("tree", "depth", "rank", "node"), levels)

    # the tree over the trees
    tops = forest.tops
    size = tops.agg(F.max(F.octet_length("tree")), F.count("*")).first()
    keys = string_keys("tree", size[0] or 0)
    names = [f"_k{i}" for i in range(len(keys))]
    one = tops.select(F.lit("all").alias("whole"), "tree", "top", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    placed = reused(ranks(one, ["whole"], names).select("tree", "top", "rank"), "tops")
    summit_leaves = placed.select(F.lit("").alias("tree"), F.lit(size[1]).alias("_n"), "rank", F.col("top").alias("node"))
    summit_leaves = summit_leaves.select("tree", depth("_n").alias("depth"), "rank", "node")
    summit = grow(summit_leaves, levels)
    over = _down(summit_leaves, summit.paths_above_blocks(), levels).select("rank", F.col("lefts").alias("over_l"), F.col("rights").alias("over_r"))
    root = summit.tops.first()
    trees = reused(placed.join(over, "rank").withColumn("root", F.lit(root.top if root else None).cast("string")), "trees")

    upper = forest.paths_above_blocks().select("tree", F.col("rank").alias("block"), "lefts", "rights")
    joined = upper.join(trees.drop("rank"), "tree")
    paths = joined.select("tree", "block", "top", "root", F.concat("lefts", "over_l").alias("lefts"), F.concat("rights", "over_r").alias("rights"))
    return Manifest(leaves, paths, trees, levels)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(docs, "doc_id", "lang", COLUMNS, {"text": F.translate("text", UPPER, LOWERED)}, tampered)
    return made.proofs().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
rows AS (SELECT doc_id, lang, source, n_chars, text, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT) AS b FROM documents),
judged AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295) % 3 = 0, false) AS hit FROM rows, crc),
claimed AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM judged),
heads AS (SELECT doc_id, lang, text, text2, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
  coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM claimed),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS claim FROM heads),
leaves AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes(g, lvl, i, h, n) AS (SELECT g, 0, i, leaf, n FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 8),
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
above(lvl, i, h, n) AS (SELECT 0, i, subroot, n FROM tops
  UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM above WHERE n > 1 GROUP BY lvl, i // 8),
runs AS (SELECT g, lvl, i // 8 AS up, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
above_runs AS (SELECT lvl, i // 8 AS up, list(h ORDER BY i) AS hs FROM above WHERE n > 1 GROUP BY ALL),
path AS (SELECT doc_id, leaf, g, 0 AS lvl, i AS i, claim AS at_claim, '' AS proof, row_number() OVER () AS id FROM leaves
  UNION ALL SELECT doc_id, leaf, p.g, p.lvl + 1, p.i // 8, sha256(array_to_string(hs[:p.i % 8], '') || at_claim || array_to_string(hs[p.i % 8 + 2:], '')),
    proof || array_to_string(hs[:p.i % 8], '') || array_to_string(hs[p.i % 8 + 2:], ''), id FROM path p JOIN runs r ON r.g = p.g AND r.lvl = p.lvl AND r.up = p.i // 8),
done AS (SELECT p.* FROM path p JOIN (SELECT g, max(lvl) AS lvl FROM nodes GROUP BY g) m ON m.g = p.g AND m.lvl = p.lvl),
over AS (SELECT doc_id, leaf, d.g, subroot, 0 AS lvl, t.i AS i, at_claim, proof, id FROM done d JOIN tops t ON t.g = d.g
  UNION ALL SELECT doc_id, leaf, g, subroot, o.lvl + 1, o.i // 8, sha256(array_to_string(hs[:o.i % 8], '') || at_claim || array_to_string(hs[o.i % 8 + 2:], '')),
    proof || array_to_string(hs[:o.i % 8], '') || array_to_string(hs[o.i % 8 + 2:], ''), id FROM over o JOIN above_runs r ON r.lvl = o.lvl AND r.up = o.i // 8),
ended AS (SELECT o.* FROM over o WHERE lvl = (SELECT max(lvl) FROM above))
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, at_claim AS folded_root, at_claim = h AS verified FROM ended, (SELECT h FROM above WHERE n = 1)
"""
