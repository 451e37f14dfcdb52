"""The prefix trie of all conversations: members, children, leaves and the words that sharing each prefix saves.

Turns become dictionary numbers, conversations arrays of them. Equal conversations are folded to one counted row, the distinct
ones dealt over ranges in lexicographic order. A shard, a run of consecutive sequences, is one ternary search tree, filled middle
first so that siblings stay balanced, and walked with a stack. A node off the first and last path of its shard lies in that
shard alone and is final there. Nodes on these two paths may go on in other shards; they are merged by the digest of their path.
What lies below a merged node is an interval in lexicographic order, so its leaves and savings are a difference of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import crc32_sql, stored, table
from wheelbase.operators.ordering import numbered, with_sums_before

# A conversation takes its opening, of at most HEADS - 1 turns, from the one with id conv_id - conv_id % SHARED (the remainder has the sign of the id).
SHARED, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
# Turns of a shard; a longer conversation is a shard of its own.
SHARD_TURNS = 100_000
# Conversations whose ids are hashed as one piece of text.
PIECE = 512
# A turn with at least this share of all rows is joined to the dictionary in SALTS parts; there are at most SALTS such turns.
SALTS = 64
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): every conversation as the numbers of its turns and their word counts, by turn (null first).

    Turns with equal numbers of ``turn`` follow their dictionary numbers. A conversation is a record that one task holds: 16 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = stored(conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    ))
    counted = stored(turns.groupBy("digest").agg(F.count("*").alias("n"), F.min("words").alias("words")))
    total = counted.agg(F.sum("n")).scalar()
    frequent = counted.filter(F.col("n") * SALTS >= total)
    hot = frequent.agg(F.collect_list("digest")).scalar()
    dictionary = numbered(counted, ["digest"], "id")
    copies = F.when(F.array_contains(hot, F.col("digest")), SALTS).otherwise(1)
    copied = dictionary.select("digest", "id", "words", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    salt = F.when(F.array_contains(hot, F.col("digest")), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    numbers = turns.drop("words").withColumn("salt", salt).join(copied, ["digest", "salt"])
    listed = numbers.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with the opening of its lead: the first h turns of conv_id - conv_id % SHARED, then its own after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    leads = own.filter(F.col("conv_id") % SHARED == 0).select(
        F.col("conv_id").alias("lead"), F.slice("ids", 1, HEADS - 1).alias("lead_ids"), F.slice("words", 1, HEADS - 1).alias("lead_words"))
    joined = own.withColumn("lead", F.col("conv_id") - F.col("conv_id") % SHARED).withColumn("h", h).join(leads, "lead", "left")

    def spliced(name: str, kind: str):
        opening = F.slice(F.coalesce(f"lead_{name}", F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(opening, F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))).alias(name)

    return joined.select("conv_id", spliced("ids", "long"), spliced("words", "int"))


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text, sorted by (key, piece), to one digest per key of the pieces joined by commas. Holds one digest state."""
    key, state = None, None

    def row():
        return pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if k != key:
                if key is not None:
                    yield row()
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield row()


def ends(keyed: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ascending ids of the conversations with that key.

    Ids are joined to pieces of at most PIECE before they meet, so the task that hashes a long list reads few rows.
    """
    pieces = numbered(keyed, ["conv_id"], "no").groupBy("key", F.floor(F.col("no") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "text").mapInArrow(_hashed_lists, "key string, ends_sha256 string")


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every stretch before its halves."""
    stack = [(0, n)]
    while stack:
        start, end = stack.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            stack += [(middle + 1, end), (start, middle)]


class TernaryTree:
    """One shard's sequences. Node 0 is the textless root; ``down`` leads to a node's children, ``low`` and ``high`` between siblings."""

    def __init__(self):
        self.turn, self.words, self.depth, self.up = [0], [0], [0], [-1]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def _new(self, turn: int, words: int, up: int) -> int:
        for values, value in ((self.turn, turn), (self.words, words), (self.depth, self.depth[up] + 1), (self.up, up), (self.low, -1), (self.high, -1), (self.down, -1)):
            values.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], words: list[int]) -> list[int]:
        """The nodes on the path of a sequence, the root first; missing ones are made."""
        path = [0]
        for turn, count in zip(ids, words):
            up = path[-1]
            links, at = self.down, up
            while links[at] >= 0 and self.turn[links[at]] != turn:
                at = links[at]
                links = self.low if turn < self.turn[at] else self.high
            if links[at] < 0:
                links[at] = self._new(turn, count, up)
            path.append(links[at])
        return path

    def walk(self) -> list[int]:
        """All nodes in lexicographic order, a parent before its children."""
        order, stack = [0], [(self.down[0], False)]
        while stack:
            node, passed = stack.pop()
            if node < 0:
                continue
            if passed:
                order.append(node)
            else:
                stack += [(self.high[node], False), (self.down[node], False), (node, True), (self.low[node], False)]
        return order


def path_keys(ids: list[int]) -> list[str]:
    """A digest of every prefix of a sequence, the empty one first."""
    keys = [NOTHING]
    for i in ids:
        keys.append(hashlib.sha256(f"{keys[-1]},{i}".encode()).hexdigest())
    return keys


_NODE_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()),
    ("first", pa.int64()), ("last", pa.int64()),
])
NODES = ("shard long, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, words long, ends_sha256 string, first long, last long")


def shard_nodes(shard: int, start: int, rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of one shard. ``rows`` are its sorted distinct sequences: (ids, words, n, conv_id, ends_sha256), numbered from ``start``.

    Nodes on the first and the last path have a key; for them children, leaves and savings count only what is below them and has no key.
    """
    tree = TernaryTree()
    end_of = [0] * len(rows)
    for i in medians(len(rows)):
        end_of[i] = tree.insert(rows[i][0], rows[i][1])[-1]
    size = len(tree.turn)
    members, smallest, first, last, ending = [0] * size, [None] * size, [None] * size, [None] * size, [None] * size
    for i, node in enumerate(end_of):
        members[node], smallest[node], first[node], last[node], ending[node] = rows[i][2], rows[i][3], start + i, start + i, rows[i][4]
    key = [None] * size
    for ids, words in ((rows[0][0], rows[0][1]), (rows[-1][0], rows[-1][1])):
        for node, name in zip(tree.insert(ids, words), path_keys(ids)):
            key[node] = name
    order = tree.walk()
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        if key[node] is None:
            saved[node] += (members[node] - 1) * tree.words[node]
            leaves[node] = leaves[node] or 1
        if node:
            up = tree.up[node]
            members[up] += members[node]
            smallest[up] = smallest[node] if smallest[up] is None else min(smallest[up], smallest[node])
            first[up] = first[node] if first[up] is None else min(first[up], first[node])
            last[up] = last[node] if last[up] is None else max(last[up], last[node])
            children[up] += key[node] is None
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    up_key = [key[tree.up[v]] if v else None for v in range(size)]
    columns = [
        [shard] * size, key, up_key, smallest, tree.depth, [smallest[tree.up[v]] if v and up_key[v] is None else None for v in range(size)],
        members, children, leaves, saved, tree.words, ending, first, last,
    ]
    return pa.record_batch([pa.array([c[v] for v in order], f.type) for c, f in zip(columns, _NODE_SCHEMA)], schema=_NODE_SCHEMA)


def _sharded(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of a partition's sequences, a shard of at most ``most`` turns at a time."""
        rows, turns, place, part = [], 0, 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "ids", "words", "n", "first", "ends_sha256")]
            for i in range(batch.num_rows):
                part, *row = (c[i].as_py() for c in columns)
                if rows and turns + len(row[0]) > most:
                    yield shard_nodes((part << 32) + place, (part << 32) + place, rows)
                    place, rows, turns = place + len(rows), [], 0
                rows.append(tuple(row))
                turns += len(row[0])
        if rows:
            yield shard_nodes((part << 32) + place, (part << 32) + place, rows)

    return run


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def merged(nodes: DataFrame) -> DataFrame:
    """All nodes of the trie from the shards' nodes: those with a key are added up, and the others get the parents they lacked."""
    partial = nodes.filter("key is not null")
    sums = stored(partial.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("words").alias("words"),
        F.max("ends_sha256").alias("ends_sha256"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    ))
    keyed_children = sums.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    counted = stored(sums.join(keyed_children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # One event where a node begins, with what it adds itself, and one where its last sequence ends: the difference is its subtree.
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    begin = F.struct(F.col("first").alias("at"), F.lit(0).alias("end"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    finish = F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("own"))
    events = counted.select("key", "depth", F.inline(F.array(begin, finish)))
    running = with_sums_before(events, [], ["at", "end", "depth"], {"leaves": F.col("leaf"), "saved": F.col("own")})
    sign = F.when(F.col("end") == 1, 1).otherwise(-1)
    below = running.groupBy("key").agg(F.sum(sign * F.col("leaves")).alias("leaves"), F.sum(sign * F.col("saved")).alias("saved"))
    whole = stored(counted.join(below, "key").withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")}).drop("leaves", "saved"))
    parent = whole.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    boundary = whole.join(parent, F.col("parent_key") == F.col("of"), "left")
    # The parents' ids travel by shard, so that the many children of one node, such as the root, do not meet in one task.
    known = partial.select(F.col("shard").alias("s"), "key").join(parent, F.col("key") == F.col("of")).select("s", F.col("of").alias("k"), F.col("parent_conv_id").alias("found"))
    inner = nodes.filter("key is null").join(known, (F.col("shard") == F.col("s")) & (F.col("parent_key") == F.col("k")), "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    both = inner.select(*RESULT).unionByName(boundary.select(*RESULT))
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, the textless root included.

    Reads conv_id, turn, role and text; other columns are ignored, whatever their names. Null roles and texts count as empty,
    rows without conv_id are left out, rows equal in every column are turns of their own, empty and very long texts
    are compared whole (by SHA-256). A conversation that loses all of its turns is a member of the root. No conversations, no rows.
    """
    sequences = stored(rebuilt(encoded(conversations)).withColumn("key", F.sha2(F.array_join("ids", ","), 256)))
    folded = sequences.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.min("ids").alias("ids"), F.min("words").alias("words"))
    distinct = folded.join(ends(sequences.select("key", "conv_id")), "key").drop("key")
    ranges = max(2, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = stored(distinct).repartitionByRange(ranges, "ids").sortWithinPartitions("ids").withColumn("part", F.spark_partition_id().cast("long"))
    return merged(stored(ordered.mapInArrow(_sharded(shard_turns), NODES)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations``."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
split AS (SELECT conv_id, t, {crc32_sql("conv_id")} % {HEADS} AS h, conv_id - conv_id % {SHARED} AS lead FROM own),
whole AS (SELECT a.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, a.h), list_slice(a.t, a.h + 1, len(a.t))) AS t FROM split a LEFT JOIN own b ON b.conv_id = a.lead),
steps AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM whole),
nodes AS (SELECT list_slice(t, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = depth), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
parents AS (SELECT *, CASE WHEN depth > 0 THEN list_slice(p, 1, depth - 1) END AS q FROM nodes),
children AS (SELECT q, count(*) AS n_children FROM parents WHERE q IS NOT NULL GROUP BY 1),
valued AS (SELECT a.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * len(regexp_extract_all(a.p[-1].text, '{WORD}')) END AS saved
  FROM parents a LEFT JOIN children c ON c.q = a.p),
below AS (SELECT list_slice(p, 1, k) AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN below b ON b.top = v.p LEFT JOIN nodes u ON u.p = v.q"""
