"""Dataset manifest: a ternary Merkle tree per source and one over the sources, with proofs for every row.

Leaves are numbered by a prefix scan over (source, doc_id). Subtrees of ``SIDE ** depth`` leaves are hashed inside one group
each, their tops again, so a tree of n leaves takes log(n) / log(block) rounds and no group holds more than one block of nodes.

Proofs are octopus multiproofs. A leaf partition is a block of consecutive leaves of one source; it works out the minimal
set of nodes that its leaves' proofs need and that it cannot derive, fetches these once, derives all interior nodes
between its leaves, and expands the proof of each leaf from what it then holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import crc32_sql, stored, table
from wheelbase.operators.ordering import numbered

SIDE = 3
# Levels of a block: 3 ** 8 = 6,561 leaves, under 2 MB of digests.
DEPTH = 8
# Leaf partitions that read one copy of an upper node.
READERS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: number of the tree over the sources; a source's own tree has the source's number
TOP = -1

NODES = "tree long, level int, idx long, n long, digest string"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _framed(column: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, shown): the digest of each row, and of the row as it is shown to the verifier.

    Rows whose doc_id has an even crc32 are shown with the line feeds of their text taken out. A null doc_id is never tampered with.
    """
    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[_framed(text if f == "text" else F.col(f)) for f in FIELDS]), 256)

    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = even & F.contains(F.col("text"), F.lit("\n"))
    own = docs.select(*FIELDS).select("doc_id", "source", leaf(F.col("text")).alias("leaf"),
                                      F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("shown"))
    return own.withColumn("shown", F.coalesce("shown", "leaf"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``tree``, ``idx`` and ``n``; one row per source with its number and number of leaves).

    Sources come null first and then by UTF-8 bytes, leaves by doc_id; rows equal in both by their digests, so
    that repeated rows, whose digests are equal, give the same tree in any order.
    """
    rows = stored(numbered(leaves(docs), ["source", "doc_id", "leaf", "shown"], "row"))
    per_source = rows.groupBy("source").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    sources = stored(numbered(per_source, ["source"], "tree"))
    # The numbers of a source travel by the ranges of rows that it covers, so a source with very many rows is no hot key.
    span = 3**DEPTH
    covered = F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("n") - 1) / span))
    known = sources.select(F.col("source").alias("of"), F.struct("tree", "first", "n").alias("k"), F.explode(covered).alias("covered"))
    keyed = rows.withColumn("block", F.floor(F.col("row") / span))
    found = keyed.join(known, (F.col("block") == F.col("covered")) & F.col("source").eqNullSafe(F.col("of")))
    return found.select("doc_id", "leaf", "shown", "k.tree", (F.col("row") - F.col("k.first")).alias("idx"), "k.n"), sources


def parents(nodes: list[str]) -> list[str]:
    """One level up: every SIDE consecutive nodes become one."""
    return [digest(nodes[i:i + SIDE]) for i in range(0, len(nodes), SIDE)]


def _subtree(depth: int, lowest: int):
    def run(block: pa.Table) -> pa.Table:
        """The nodes above a block, up to ``depth`` levels higher or the tree's root; of the others only those from level ``lowest`` up."""
        rows = block.sort_by("idx")
        tree, level, n, first = (rows.column(c)[0].as_py() for c in ("tree", "level", "n", "idx"))
        nodes = rows.column("digest").to_pylist()
        out = []
        for step in range(depth + 1):
            if level + step >= lowest or n == 1 or step == depth:
                out += [(tree, level + step, first + i, n, node) for i, node in enumerate(nodes)]
            if n == 1:
                break
            nodes, first, n = parents(nodes), first // SIDE, -(-n // SIDE)
        return pa.table(list(map(list, zip(*out))), schema=_NODE_SCHEMA)

    return run


_NODE_SCHEMA = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def grown(leaf_nodes: DataFrame, lowest: int, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(tree, digest) of the roots of all trees, and all nodes below the roots from level ``lowest`` up.

    ``leaf_nodes`` has (tree, idx, n, digest). Every round hashes blocks of SIDE ** depth nodes, so a block is all that a task holds.
    """
    span = SIDE**depth
    level = leaf_nodes.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    largest = leaf_nodes.agg(F.max("n")).first()[0] or 0
    roots, nodes, at = [], [], 0
    while not roots or largest > SIDE**at:
        made = stored(level.groupBy("tree", "level", F.floor(F.col("idx") / span).alias("block")).applyInArrow(_subtree(depth, lowest), NODES))
        roots.append(made.filter("n = 1").select("tree", "digest"))
        nodes.append(made.filter((F.col("n") > 1) & (F.col("level") >= lowest) & (F.col("level") < at + depth)).select("tree", "level", "idx", "digest"))
        at += depth
        level = made.filter((F.col("level") == at) & (F.col("n") > 1))
    return reduce(DataFrame.union, roots), reduce(DataFrame.union, nodes)


def coordinates(first: int, count: int, n: int) -> list[tuple[int, int]]:
    """The octopus: (level, index) of the fewest nodes that, with leaves first .. first + count - 1 of n, give the root."""
    out, low, high, level = [], first, first + count - 1, 0
    while n > 1:
        start, end = low // SIDE * SIDE, min(high // SIDE * SIDE + SIDE, n)
        out += [(level, i) for i in (*range(start, low), *range(high + 1, end))]
        low, high, n, level = low // SIDE, high // SIDE, -(-n // SIDE), level + 1
    return out


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The coordinates that each leaf partition (of, part) fetches, of its own tree and of the tree over the sources."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            out += [(row["tree"], row["part"], row["tree"], *c) for c in coordinates(row["first"], row["count"], row["n"])]
            out += [(row["tree"], row["part"], TOP, *c) for c in coordinates(row["tree"], 1, row["sources"])]
        columns = list(map(list, zip(*out))) or [[]] * len(_WANTED_SCHEMA)
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(columns, _WANTED_SCHEMA)], schema=_WANTED_SCHEMA)


_WANTED_SCHEMA = pa.schema([("of", pa.int64()), ("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, n_siblings int"


def _paths(known: dict[tuple[int, int], str], low: int, high: int, n: int) -> Iterator[tuple[int, int, int]]:
    """Derive every level above the known nodes low .. high; yields (level, number of nodes) of the levels below the root."""
    level = 0
    while n > 1:
        yield level, n
        for parent in range(low // SIDE, high // SIDE + 1):
            known[level + 1, parent] = digest([known[level, i] for i in range(parent * SIDE, min(parent * SIDE + SIDE, n))])
        low, high, n, level = low // SIDE, high // SIDE, -(-n // SIDE), level + 1


def _climb(known: dict[tuple[int, int], str], levels: list[tuple[int, int]], index: int, node: str) -> tuple[list[str], str]:
    """The siblings of one leaf, level by level, and what its path folds to when the leaf is ``node``."""
    proof = []
    for level, n in levels:
        start = index // SIDE * SIDE
        run = range(start, min(start + SIDE, n))
        proof += [known[level, i] for i in run if i != index]
        node = digest([node if i == index else known[level, i] for i in run])
        index //= SIDE
    return proof, node


def expand(leaf_rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs of all leaves of one partition from its leaves and the nodes fetched for it."""
    rows = leaf_rows.sort_by("idx")
    tree, n, sources = (rows.column(c)[0].as_py() for c in ("tree", "n", "sources"))
    index, leaf, shown = (rows.column(c).to_pylist() for c in ("idx", "leaf", "shown"))
    own, top = {(0, i): d for i, d in zip(index, leaf)}, {}
    for where, level, idx, node in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
        (top if where == TOP else own)[level, idx] = node
    levels = list(_paths(own, index[0], index[-1], n))
    subroot = top[0, tree] = own[len(levels), 0]
    top_levels = list(_paths(top, tree, tree, sources))
    root = top[len(top_levels), 0]
    upper, _ = _climb(top, top_levels, tree, subroot)
    out = []
    for i, d, s in zip(index, leaf, shown):
        proof, folded = _climb(own, levels, i, s)
        folded = _climb(top, top_levels, tree, folded)[1]
        out.append((d, subroot, root, digest(proof + upper), folded, len(proof) + len(upper)))
    return pa.table([rows.column("doc_id"), *map(list, zip(*out))], schema=_PROOF_SCHEMA)


_PROOF_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("n_siblings", pa.int32())])


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` with its leaf, subroot, root, proof digest, and the root that its shown form folds to.

    ``docs`` has the columns in FIELDS; others are ignored, whatever their names. Null in any field is a value of its own ('-'),
    and null sources form the first tree; a row with null doc_id is a leaf before all others of its source. Empty and very
    long texts are hashed whole in the JVM. Repeated rows are leaves of their own. A table without rows gives no rows.
    """
    span = SIDE**depth
    found, source_rows = placed(docs)
    leaf_rows = stored(found.withColumn("part", F.floor(F.col("idx") / span)))
    sources = F.lit(source_rows.count()).cast("long")
    subroots, lower = grown(leaf_rows.select("tree", "idx", "n", F.col("leaf").alias("digest")), depth, depth)
    _, upper = grown(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), sources.alias("n"), "digest"), 0, depth)

    parts = stored(leaf_rows.groupBy("tree", "n", "part").agg(F.min("idx").alias("first"), F.count("*").alias("count")))
    wanted = parts.withColumn("sources", sources).mapInArrow(_wanted, "of long, part long, tree long, level int, idx long")
    # An upper node is read by all partitions below it. It is copied so that about READERS of them share a copy.
    below = F.when(F.col("tree") == TOP, F.lit(parts.count())).otherwise(F.pow(F.lit(SIDE), F.col("level") + 1 - depth))
    copies = F.ceil(F.greatest(below / READERS, F.lit(1.0)))
    served = lower.union(upper).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    fetched = wanted.withColumn("copy", F.pmod(F.xxhash64("of", "part"), copies)).join(served, ["tree", "level", "idx", "copy"])
    return (
        leaf_rows.withColumn("sources", sources).groupBy("tree", "part")
        .cogroup(fetched.select("of", "part", "tree", "level", "idx", "digest").groupBy("of", "part"))
        .applyInArrow(expand, PROOFS)
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` with every row's proof."""
    return manifest(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    values = [text if f == "text" else f for f in FIELDS]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}::VARCHAR), ':', {v}) END" for v in values) + "))"


def _grown_sql(name: str, leaves_sql: str) -> str:
    """All nodes of the trees whose leaves (tree, idx, n, digest) are given, as the recursive table ``name``."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, idx, n, digest FROM ({leaves_sql})
  UNION ALL
  SELECT tree, level + 1, idx // {SIDE}, (n + {SIDE - 1}) // {SIDE}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY tree, level, idx // {SIDE}, n)"""


def _climb_sql(name: str, start: str, nodes: str) -> str:
    """The path of every row of ``start`` (row, tree, idx, folded, proof) up to its root, one level a step."""
    return f"""{name} AS (
  SELECT row, tree, 0 AS level, idx, folded, proof FROM {start}
  UNION ALL
  SELECT p.row, p.tree, p.level + 1, p.idx // {SIDE}, sha256(string_agg(CASE WHEN o.idx = p.idx THEN p.folded ELSE o.digest END, '' ORDER BY o.idx)),
    concat(p.proof, string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx <> p.idx))
  FROM {name} p JOIN {nodes} o ON o.tree = p.tree AND o.level = p.level AND o.n > 1 AND o.idx // {SIDE} = p.idx // {SIDE}
  GROUP BY p.row, p.tree, p.level, p.idx, p.folded, p.proof)"""


_LAST = "SELECT row, tree, idx, folded, proof FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level DESC) AS k FROM {}) WHERE k = 1"

_SHOWN = f"(CASE WHEN {crc32_sql('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)"

OP11_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, {_leaf_sql("text")} AS leaf, {_leaf_sql(_SHOWN)} AS shown, row_number() OVER () AS row,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM documents),
{_grown_sql("nodes", "SELECT tree, idx, n, leaf AS digest FROM leaves")},
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
{_grown_sql("tops", f"SELECT {TOP} AS tree, tree AS idx, count(*) OVER () AS n, digest FROM subroots")},
own AS (SELECT row, tree, idx, shown AS folded, '' AS proof FROM leaves),
{_climb_sql("paths", "own", "nodes")},
inner_ends AS ({_LAST.format("paths")}),
upper_starts AS (SELECT row, {TOP} AS tree, tree AS idx, folded, proof FROM inner_ends),
{_climb_sql("upper_paths", "upper_starts", "tops")},
ends AS ({_LAST.format("upper_paths")})
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  (strlen(e.proof) // 64)::INT AS n_siblings, e.folded = t.digest AS verified
FROM leaves l JOIN ends e ON e.row = l.row JOIN subroots s ON s.tree = l.tree JOIN tops t ON t.n = 1"""
