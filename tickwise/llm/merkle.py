"""Merkle manifest of a table, by time-forward processing.

Every node of a tree has a label, the last leaf under it and then its height, so that children come
before parents. A sweep in label order takes the messages to a node from a priority queue, makes its
digest of them and sends that to its parent. The queue has two parts: messages between nodes of one
block of leaves stay in a heap of the task (a few for each level); messages across blocks are rows of a
table in the shared folder that the next round's shuffle sorts by label. A sweep in the opposite order
sends every node's proof suffix (the siblings from there to the root) to its children. A round climbs
`levels` levels of all trees at once, so their number grows with the logarithm of the largest tree, and
no task holds more than one block.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import checked_broadcast, cut, map_groups

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(parts: list[bytes]) -> bytes:
    """SHA-256 of digests, put together as hex text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(v) for v in values]).cast("binary"), 256))


def up_sweep(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """The levels of one block: its leaves, then their parents, up to `height` levels above.

    The queue holds (label, child, digest); a node is due once no message with a smaller label is left.
    """
    out: list[list[bytes]] = [[] for _ in range(height + 1)]
    queue: list[tuple[int, int, int, bytes]] = []  # last leaf of the parent, its height, place of the child, digest
    last = len(leaves) - 1

    def send(level: int, at: int, digest: bytes) -> None:
        out[level].append(digest)
        if level < height:
            width = ARITY ** (level + 1)
            heapq.heappush(queue, (min(last, (at // ARITY + 1) * width - 1), level + 1, at, digest))

    for i, digest in enumerate(leaves):
        send(0, i, digest)
        while queue and queue[0][0] <= i:
            label, level, at, first = heapq.heappop(queue)
            parts = [first]
            while queue and queue[0][:2] == (label, level):
                parts.append(heapq.heappop(queue)[3])
            send(level, at // ARITY, digest_of(parts))
    return out


def down_sweep(levels: list[list[bytes]], suffix: bytes) -> list[bytes]:
    """The proof suffix of each leaf of a block, from that of the block's top node.

    A suffix is, level by level, the node's place in its run, the length of the run, and its siblings' digests.
    """
    last = len(levels[0]) - 1
    out: list[bytes] = [b""] * len(levels[0])
    queue: list[tuple[int, int, int, bytes]] = []  # the label, negative, then place and suffix

    def send(level: int, at: int, tail: bytes) -> None:
        heapq.heappush(queue, (-min(last, (at + 1) * ARITY**level - 1), -level, at, tail))

    send(len(levels) - 1, 0, suffix)
    while queue:
        _, negative, at, tail = heapq.heappop(queue)
        if not negative:
            out[at] = tail
            continue
        run = levels[-negative - 1][at * ARITY : (at + 1) * ARITY]
        for k in range(len(run)):
            send(-negative - 1, at * ARITY + k, bytes((k, len(run))) + b"".join(run[:k] + run[k + 1 :]) + tail)
    return out


def fold(leaf: bytes, suffix: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    i, digest = 0, leaf
    while i < len(suffix):
        k, n = suffix[i], suffix[i + 1]
        rest = [suffix[i + 2 + 32 * j : i + 34 + 32 * j] for j in range(n - 1)]
        digest = digest_of([*rest[:k], digest, *rest[k:]])
        i += 2 + 32 * (n - 1)
    return digest


def proof_digest(suffix: bytes) -> str:
    """SHA-256 of the proof's digests as hex text, bottom to top, each level left to right."""
    i, parts = 0, []
    while i < len(suffix):
        n = suffix[i + 1]
        parts.append(suffix[i + 2 : i + 2 + 32 * (n - 1)].hex())
        i += 2 + 32 * (n - 1)
    return sha256("".join(parts).encode()).hexdigest()


def _numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with the place `at` of each row in its tree by the order, and the tree's number n of rows.

    Rows are dealt by ranges of (tree, order), so that a large tree spreads over partitions; the places
    in a partition continue from the counts of those before it.
    """
    # Rows that are alike in tree and order are told apart by their place in df, a written table, so that they spread as well.
    dealt = df.withColumn("salt", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(F.col(tree), *[F.col(c) for c in order], F.col("salt")).sortWithinPartitions(tree, *order, "salt")
    seen = cut(dealt.withColumn("seat", F.monotonically_increasing_id()).drop("salt"))
    seen = seen.withColumn("part", F.shiftright("seat", 33)).withColumn("seat", F.col("seat").bitwiseAND((1 << 33) - 1))
    # A row for each tree and partition that meet: no more than trees and partitions together.
    met = seen.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seat").alias("first"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select(tree, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    return seen.join(checked_broadcast(met), [tree, "part"]).withColumn("at", F.col("seat") + F.col("shift")).drop("seat", "part", "shift")


def _height(n: Column, levels: int) -> Column:
    """Levels of one round for a tree of n nodes: until one is left, `levels` at most."""
    out = F.lit(levels)
    for k in reversed(range(levels)):
        out = F.when(n <= ARITY**k, F.lit(k)).otherwise(out)
    return out


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Rounds of nodes(tree, at, digest, n), from the given ones to one node a tree."""
    width = ARITY**levels
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])

    def block(group: pa.RecordBatch) -> dict:
        height = group.column(group.schema.get_field_index("height"))[0].as_py()
        top = up_sweep(group.column(group.schema.get_field_index("digest")).to_pylist(), height)[-1]
        tree, n, b = (group.column(group.schema.get_field_index(c))[0].as_py() for c in ("tree", "n", "block"))
        return {"tree": [tree], "at": [b], "digest": top, "n": [-(-n // width)]}

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        dealt = rounds[-1].select("tree", F.floor(F.col("at") / width).alias("block"), "at", "digest", "n", _height(F.col("n"), levels).alias("height"))
        rounds.append(cut(map_groups(dealt, ["tree", "block"], block, schema, "tree string, at long, digest binary, n long", sort=["at"])))
    return rounds


def _deliver(nodes: DataFrame, messages: DataFrame, levels: int) -> DataFrame:
    """nodes with what reached them: messages(tree, at, suffix, subroot, root) for the tops of the blocks, handed down to the nodes."""
    width = ARITY**levels
    keep = [f for f in nodes.schema.fields if f.name not in ("tree", "at", "digest", "n")]
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.binary()), ("suffix", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()), *[(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.binary()) for f in keep]])
    ddl = ", ".join(["tree string, at long, digest binary, suffix binary, subroot binary, root binary", *[f"{f.name} {f.dataType.simpleString()}" for f in keep]])
    # The message comes first of its block: a place before all nodes.
    none = F.lit(None).cast("binary")
    rows = nodes.select("tree", F.floor(F.col("at") / width).alias("block"), "at", "digest", _height(F.col("n"), levels).alias("height"), none.alias("suffix"), none.alias("subroot"), none.alias("root"), *[f.name for f in keep])
    sent = messages.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), none.alias("digest"), F.lit(0).alias("height"), "suffix", "subroot", "root", *[F.lit(None).cast(f.dataType).alias(f.name) for f in keep])

    def block(group: pa.RecordBatch) -> dict:
        get = lambda c: group.column(group.schema.get_field_index(c))
        suffix, subroot, root = (get(c)[0].as_py() for c in ("suffix", "subroot", "root"))
        digests, rest, n = get("digest").to_pylist()[1:], group.slice(1), group.num_rows - 1
        tails = down_sweep(up_sweep(digests, get("height")[1].as_py()), suffix)
        column = lambda c: rest.column(rest.schema.get_field_index(c)).to_pylist()
        return {"tree": column("tree"), "at": column("at"), "digest": digests, "suffix": tails, "subroot": [subroot] * n, "root": [root] * n} | {f.name: column(f.name) for f in keep}

    return map_groups(rows.unionByName(sent), ["tree", "block"], block, schema, ddl, sort=["at"])


def manifest(docs: DataFrame, *, forged: Column | None = None, fields: tuple[str, ...] = FIELDS, levels: int = 3) -> DataFrame:
    """docs(doc_id, lang, and the fields) -> (doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified).

    One leaf a row; a tree for each lang by ascending doc_id, and one over their roots by lang (null first,
    bytewise), runs of ARITY nodes each. proof is binary: see down_sweep. forged, a text, replaces the text
    of the rows where it is not null when the proof is checked: folded_root is what the (forged) leaf and
    the proof give. A null doc_id comes first; rows of one doc_id are ordered by leaf, so that repeated rows
    have equal leaves side by side and each its own proof. Every value may be null; a table without rows
    gives none. Further columns, whatever their names, are ignored. The frame is read once; no task holds
    more than one block of ARITY ** levels nodes.
    """
    values = {c: F.col(c) for c in fields}
    leaf = leaf_digest(*values.values())
    fake = F.lit(None).cast("binary") if forged is None else F.when(forged.isNotNull(), leaf_digest(*(values | {"text": forged}).values()))
    # A tree's name: empty for null, so that it sorts first, else a mark and the lang.
    named = docs.select(F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), fake.alias("fake"))
    leaves = _numbered(cut(named), "tree", ["doc_id", "digest"])
    rounds = _climb(leaves, levels)
    tops = rounds[-1].select(F.lit("").alias("whole"), F.col("tree").alias("name"), "digest")
    above = _climb(_numbered(cut(tops), "whole", ["name"]).select(F.col("whole").alias("tree"), "at", "digest", "n", F.col("name").cast("binary").alias("name")), levels)
    # Down again: the root sends an empty suffix.
    nothing = F.lit(b"").cast("binary")
    messages = above[-1].select("tree", "at", nothing.alias("suffix"), nothing.alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        messages = cut(_deliver(nodes, messages, levels))
    if len(above) == 1:  # a single tree: its root is the root
        messages = above[-1].select("tree", "at", "digest", nothing.alias("suffix"), nothing.alias("subroot"), F.col("digest").alias("root"), "name")
    messages = messages.select(F.col("name").cast("string").alias("tree"), F.lit(0).cast("long").alias("at"), "suffix", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[:-1]):
        messages = cut(_deliver(nodes, messages, levels))
    if len(rounds) == 1:  # every tree is a single leaf
        messages = rounds[0].select("tree", "at", "digest", "doc_id", "fake").join(messages.drop("at"), "tree")

    def check(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            suffixes = get("suffix")
            ends = [fold(d if f is None else f, s) for d, f, s in zip(get("digest"), get("fake"), suffixes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(get("doc_id"), pa.int64()), *[pa.array([d.hex() for d in get(c)], pa.string()) for c in ("digest", "subroot", "root")], pa.array(suffixes, pa.binary()), pa.array([proof_digest(s) for s in suffixes], pa.string()), pa.array([e.hex() for e in ends], pa.string()), pa.array([e == r for e, r in zip(ends, get("root"), strict=True)], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"],
            )

    return messages.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean")


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts without capitals pass unread by the slower function."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, _UP, _LOW)).otherwise(text)
