"""Near-duplicate documents: chosen-path set-similarity join over minwise sketches.

1. One pass over the texts makes each document's set of word shingles (64-bit hashes), a hash of
   the whole set and a sketch of minwise values. Equal sets collapse to one representative.
2. Independent trees branch the representatives by selected minwise tokens: a node that holds few
   documents is a leaf, a larger one branches again by coordinates that its own path chooses.
   A quick pass of two shallow trees comes first; in the other trees a node whose members it has
   all put into one class already is left out, so that large groups of near copies do not grow.
3. Inside each leaf all sketches are compared. Large nodes are dealt to blocks, each with common
   anchors; members outside the node's largest class then meet all others by pairs of blocks.
4. The classes so found are candidates. Inside each, the full sets are compared in the same way,
   and only pairs that reach the similarity link. Where most of a large group stays unlinked, it
   branches again by the tokens that no more than half of it shares.

Nothing emits pairs: blocks return one row per document that has a link, so a group of n copies
costs rows in proportion to n.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import checked_broadcast, cut, map_batches, map_groups, mix64, texts_of
from tickwise.llm.components import connected_components

SKETCH, TOKENS = 64, 32
_MULTIPLIERS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: str, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words divided by ASCII white space."""
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, dtype=np.uint64)
    ids = np.empty(len(split), dtype=np.uint64)
    for i, w in enumerate(split):
        h = known.get(w)
        if h is None:
            if len(known) > 150_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids[i] = h
    n = min(words, len(ids))
    rolled = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        rolled = mix64(rolled * np.uint64(0x100000001B3) + ids[i : len(ids) - n + 1 + i])
    return np.unique(rolled)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of 32 bits."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(hashes), 8192):
        part = hashes[begin : begin + 8192]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, tokens, sketch) of every row: tokens are the values that paths choose from, sketch 16 bits of each of the others."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), *[(c, pa.binary()) for c in ("set_hash", "tokens", "sketch")]])
    known: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            hashes = shingle_hashes(text, words, known)
            least = sketch_of(hashes)
            rows.append((doc_id, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), least[:TOKENS].tobytes(), least[TOKENS:].astype(np.uint16).tobytes()) if len(hashes) else (doc_id, 0, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, set_hash binary, tokens binary, sketch binary")


def _value(i: int, size: int) -> Column:
    """The low 1 or 2 bytes of a document's i-th minwise value."""
    return F.substring("tokens", i * 4 + 1, size) if i < TOKENS else F.substring("sketch", (i - TOKENS) * 2 + 1, size)


def _id_filter(ids: DataFrame, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """Bloom filter of ids(doc), two hashes: 16 bits for each, 16 MB at most. It only spares work: an exact join follows."""
    bits = 1 << 16
    want = 16 * ids.count()
    while bits < min(want, most_bits):
        bits *= 2
    hashed = ids.select(F.xxhash64(F.lit(5), "doc").alias("h")).select(F.explode(F.array("h", F.shiftright("h", 32))).alias("h"))
    at = hashed.select(F.col("h").bitwiseAND(bits - 1).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words, bits


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc, set_hash, members): the full shingle sets of ids(doc, set_hash) and of few others, made from the texts once more.

    Dealt by doc and set_hash, so that a join by these moves no set again.
    """
    table, bits = _id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("doc", pa.int64()), ("set_hash", pa.binary()), ("members", pa.binary())])
    known: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        h = batch.column(1).to_numpy()
        one, two = h & (bits - 1), (h >> 32) & (bits - 1)
        hit = np.flatnonzero((shared.value[one >> 6] >> (one & 63)) & (shared.value[two >> 6] >> (two & 63)) & 1)
        if not len(hit):
            return None
        part = batch.take(pa.array(hit))
        found = [shingle_hashes(t, words, known).tobytes() for t in texts_of(part)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in found], type=pa.binary()), pa.array(found, type=pa.binary())], schema=schema)

    asked = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text").select("doc", F.xxhash64(F.lit(5), "doc").alias("h"), "text")
    made = map_batches(asked, run, "doc long, set_hash binary, members binary").where("length(members) > 0")
    # Rows that repeat a document and its text give one set.
    return made.dropDuplicates(["doc", "set_hash"])


def _classes(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable over a symmetric boolean matrix."""
    n = len(near)
    label = np.full(n, -1)
    for root in range(n):
        if label[root] < 0:
            label[root] = root
            open_ = [root]
            while open_:
                new = np.flatnonzero(near[open_.pop()] & (label < 0))
                label[new] = root
                open_.extend(new.tolist())
    return label


def _star(ids: np.ndarray, near: np.ndarray, first: np.ndarray) -> dict | None:
    """One link from each row to the first of its class; rows flagged in `first` come before others."""
    order = np.argsort(~first, kind="stable")
    label = np.empty(len(ids), dtype=np.int64)
    label[order] = order[_classes(near[np.ix_(order, order)])]
    rows = np.flatnonzero(ids[label] != ids)
    return {"a": ids[rows], "b": ids[label[rows]]} if len(rows) else None


def _sketch_matrix(sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose sketches could come from sets of that similarity (4.5 standard errors below), of sizes that allow it."""
    least = int(np.ceil(SKETCH * (similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / SKETCH))))
    n = len(sketches)
    near = np.empty((n, n), dtype=bool)
    for begin in range(0, n, 64):
        part = sketches[begin : begin + 64]
        near[begin : begin + 64] = (part[:, None, :] == sketches[None, :, :]).sum(axis=2, dtype=np.int16) >= least
    return near & (np.minimum.outer(sizes, sizes) >= similarity * np.maximum.outer(sizes, sizes) - 1e-9)


def _set_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs with 100 * intersection >= percent * union, exactly."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    near = np.empty((len(sets), len(sets)), dtype=bool)
    for i, (begin, size) in enumerate(zip(starts, sizes, strict=True)):
        own = flat[begin : begin + size]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts).astype(np.int64)
        mark[own] = 0
        near[i] = 100 * both >= percent * (sizes + size - both)
    return near


def _compared(dealt: DataFrame, payload, near_of, parts: int | None) -> DataFrame:
    """Links (grp, a, b) inside each (grp, part) of dealt(grp, part, id, anchor); payload() has the rows (id, ...) that near_of compares."""

    def link(batch: pa.RecordBatch) -> dict | None:
        if batch.num_rows < 2:
            return None
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        got = _star(col["id"].to_numpy(zero_copy_only=False), near_of(batch), col["anchor"].to_numpy(zero_copy_only=False).astype(bool))
        return got and got | {"grp": np.full(len(got["a"]), col["grp"][0].as_py(), dtype=np.int64)}

    schema = pa.schema([("grp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    rows = payload(dealt)
    return cut(map_groups(rows if parts is None else rows.coalesce(parts), ["grp", "part"], link, schema, "grp long, a long, b long", sort=["id"]))


def _in_blocks(members: DataFrame, rank: Column) -> DataFrame:
    """(grp, part, id, anchor) of members(grp, fill, id): a block for each unit of fill, by hash, each with the group's anchors (least rank first)."""
    home = members.withColumn("blocks", F.ceil("fill").cast("long")).withColumn("part", F.pmod(F.xxhash64(F.lit(71), "id"), F.greatest("blocks", F.lit(1).cast("long"))))
    one = home.select("grp", "part", "id", F.lit(False).alias("anchor"))
    side = F.pmod(F.xxhash64(F.lit(73), "id"), F.lit(4))
    anchors = home.where("blocks > 1").groupBy("grp").agg(F.max("blocks").alias("blocks"), *[F.min_by("id", F.when(side == k, F.struct(rank, F.xxhash64(F.lit(k), "id")))).alias(f"k{k}") for k in range(4)])
    anchors = anchors.select("grp", "blocks", F.explode(F.expr("filter(array(k0, k1, k2, k3), x -> x is not null)")).alias("id"))
    return one.unionByName(anchors.select("grp", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("part"), "id", F.lit(True).alias("anchor")))


def _by_pairs(marked: DataFrame) -> DataFrame:
    """(grp, part, id, anchor) of marked(grp, id, cls, top, inside, whole): a part is a pair of blocks, one of them at least of outsiders.

    Blocks below `home` hold the class named top, the others the rest. The members of one block of
    outsiders meet in each of its pairs.
    """
    home = F.greatest(F.ceil("inside"), F.lit(1))
    dealt = marked.withColumn("home", home.cast("long")).withColumn("blocks", (home + F.greatest(F.ceil(F.col("whole") - F.col("inside")), F.lit(1))).cast("long")).withColumn("inner", F.col("cls") == F.col("top"))
    hashed = F.xxhash64(F.lit(72), "id")
    own = dealt.withColumn("own", F.when(F.col("inner"), F.pmod(hashed, "home")).otherwise(F.col("home") + F.pmod(hashed, F.col("blocks") - F.col("home"))))
    met = own.withColumn("other", F.explode(F.when(F.col("inner"), F.expr("sequence(home, blocks - 1)")).otherwise(F.expr("sequence(0L, blocks - 1)")))).where("own != other")
    return met.select("grp", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"), "id", F.lit(False).alias("anchor"))


# Where a member costs only a few rows by pairs: few blocks of outsiders, or few blocks at all.
FEW_OUTSIDERS = "ceil(whole - inside) <= 2"
FEW = f"{FEW_OUTSIDERS} or ceil(whole) <= 6"


def _by_class(members: DataFrame, few: str) -> DataFrame:
    """(grp, top, inside, whole, few) of members(grp, w, cls), groups of several classes only: the largest class, its fill and the group's."""
    sizes = members.groupBy("grp", "cls").agg(F.sum("w").alias("size"))
    largest = sizes.groupBy("grp").agg(F.max_by("cls", F.struct("size", "cls")).alias("top"), F.count(F.lit(1)).alias("classes"), F.max("size").alias("inside"), F.sum("size").alias("whole")).where("classes > 1")
    return checked_broadcast(largest.withColumn("few", F.expr(few)))


def _blocked(members: DataFrame, payload, near_of, parts: int | None, *, more: DataFrame | None = None, reps: DataFrame | None = None, levels: int = 0, exhaustive: bool = True, later: Callable | None = None) -> DataFrame:
    """Links (a, b) that span the classes of each group of members(grp, fill, id, w); w is a member's share of a block, fill the sum of a group's.

    Groups that fill no more than one block are compared whole. Larger ones go to blocks by hash, each with
    the group's anchors. Their members outside the largest class so far, if few, then meet each other and that class
    by pairs of blocks: two members of different classes meet for certain, no task holds more than two
    blocks, and rows stay in proportion to members. If many, the group branches (`_children`), up to
    `levels` times, and only what still has many outsiders then is met by pairs all the same.
    `more` are rows dealt already, compared along with the first round. `later`, of the members of large
    groups, gives the payload of the rounds after it.
    """
    links = None
    for at in range(levels + 1):
        dealt = _in_blocks(members, F.lit(0))
        found = _compared(dealt if more is None else dealt.unionByName(more), payload, near_of, parts)
        links, more = found if links is None else links.unionByName(found), None
        large = members.where("fill > 1")
        if not exhaustive or large.isEmpty():
            break
        if later is not None:
            payload, later = later(large), None
        # The first link of a member names its class; anchors come first, so the blocks of a large class agree on the name.
        first = found.groupBy("grp", F.col("a").alias("id")).agg(F.min("b").alias("cls"))
        marked = cut(large.select("grp", "id", "w").join(first, ["grp", "id"], "left").withColumn("cls", F.coalesce("cls", "id")))
        rest = marked.join(_by_class(marked, FEW), "grp")
        many = None if at == levels else cut(rest.where("not few").select("grp", "id", "w", "cls"))
        more = _by_pairs(rest if many is None else rest.where("few"))
        if many is None or many.isEmpty():
            links = links.unionByName(_compared(more, payload, near_of, parts))
            break
        members, core = _children(many, reps)
        more = more.unionByName(_in_blocks(core, F.col("rank")).withColumn("grp", F.xxhash64("grp", F.lit("core"))))
    return links.select("a", "b")


def _children(many: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smaller groups of many(grp, id, w, cls), and the groups once more with ranks by nearness to their core.

    Members that share a value of the sketch which no more than half of the group has form a child.
    Two sets that link share such values, or both are near what most of the group shares: then the
    members nearest to that core, as anchors, link with both. A child of one class, or of the same
    members as another, is left out. Of children larger than a block, those of two places of the sketch
    are followed, that cover most: no more rows than two for each member, in children half the size.
    """
    value = [F.xxhash64("grp", F.lit(i), F.substring(F.col("sketch"), i * 2 + 1, F.lit(2))) for i in range(SKETCH)]
    paths = many.join(reps.select("id", "sketch"), "id").select("grp", "id", "w", "cls", F.posexplode(F.array(*value)).alias("pos", "path"))
    totals = checked_broadcast(many.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.sum("w").alias("total_fill")))
    size = cut(paths.groupBy("grp", "pos", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("fill"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("sig")).where("n > 1").join(totals, "grp"))
    child = size.where("2 * n <= total and lo <> hi")
    cover = child.where("fill > 1").groupBy("grp", "pos").agg(F.sum("n").alias("cover")).withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("cover"), "pos"))).where("k <= 2").select("grp", "pos")
    followed = child.where("fill <= 1").unionByName(child.where("fill > 1").join(cover, ["grp", "pos"], "left_semi").select(*child.columns))
    child = followed.groupBy("n", "sig", F.when(F.col("fill") > 1, F.col("path")).alias("own")).agg(F.min("path").alias("path"), F.max("fill").alias("fill"))
    members = cut(paths.join(child.select("path", "fill"), "path").select(F.col("path").alias("grp"), "fill", "id", "w"))
    common = paths.join(checked_broadcast(size.where("2 * n > total").select("path")), "path").groupBy("grp", "id").agg((-F.count(F.lit(1))).alias("rank"))
    core = cut(many.select("grp", "id", "w").join(common, ["grp", "id"], "left").join(totals, "grp").select("grp", F.col("total_fill").alias("fill"), "id", "w", F.coalesce("rank", F.lit(0)).alias("rank")))
    return members, core


def _leaves(reps: DataFrame, trees: range, leaf: int, depth: int, parts: int, block: int, split: bool, few_rows: int = 500_000) -> tuple[DataFrame, DataFrame | None]:
    """Over all trees, of reps(id, cls, tokens): nodes to compare as (grp, fill, id, w), and nodes of few outsiders as `_by_pairs` takes them.

    A root branches by two tokens, each node below by one, and one in four of them by a second one: a pair
    at 80 % then keeps its expected number of common nodes from level to level, while less alike documents
    part. Nodes of one class are left out. With `split`, large nodes of few outsiders stop branching.
    """
    token = lambda at: F.substring(F.col("tokens"), at * 4 + 1, F.lit(4))
    share = F.lit(1.0 / block)
    level = reps.select("id", "cls", F.explode(F.array(*[F.xxhash64(F.lit(t), token(F.lit(t % TOKENS))) for t in trees])).alias("path"))
    done, pairs = [], []
    for at in range(depth):
        # Nodes that three levels did not divide below a leaf are compared as they are, if a task can hold them.
        enough = leaf if at < 3 else max(leaf, block)
        # Sizes and rows come from one exchange: it is shared where both sides of the join read the same columns, hence the ids in the sizes.
        dealt = level.repartition("path")
        size = dealt.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1 and lo <> hi and a < b").select("path", "n")
        counted = cut(dealt.join(size.hint("merge"), "path").coalesce(parts))
        last = at == depth - 1 or (counted.agg(F.max("n")).first()[0] or 0) <= enough
        done.append((counted if last else counted.where(F.col("n") <= enough)).select(F.col("path").alias("grp"), (F.col("n") * share).alias("fill"), "id", share.alias("w")))
        if last:
            break
        grown = counted.where(F.col("n") > enough)
        if split:
            marked = grown.select(F.col("path").alias("grp"), "id", share.alias("w"), "cls")
            few = _by_class(marked, f"{FEW_OUTSIDERS} and 2 * inside > whole").where("few")
            pairs.append(marked.join(few, "grp"))
            grown = grown.join(few.select(F.col("grp").alias("path")), "path", "left_anti")
        ways = [F.pmod(F.xxhash64(F.lit(b), "path"), F.lit(TOKENS // 2)).cast("int") * 2 + b for b in range(2)]
        second = F.lit(at == 0) | (F.pmod(F.xxhash64(F.lit(2), "path"), F.lit(4)) == 0)
        nodes = F.array(F.xxhash64("path", ways[0], token(ways[0])), F.when(second, F.xxhash64("path", ways[1], token(ways[1]))))
        # The tokens of all documents stay where they are if few rows go on.
        grown = F.broadcast(grown) if grown.count() <= few_rows else grown
        level = grown.join(reps.select("id", "tokens"), "id").coalesce(parts).select("id", "cls", F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("path"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, pairs) if pairs else None


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, trees: int = 13, leaf: int = 128, depth: int = 12, block: int = 512, set_block: int = 256, block_shingles: int = 2_000_000) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for each input row.

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id reachable by links. A pair exactly at 80 % shares a leaf of
    one tree with probability 0.77, and about 0.6 where its nodes stay large for some levels. All trees
    choose from the same TOKENS values, so that their misses go together; the README gives the recall
    measured against brute force. Sketches further apart than 4.5 standard errors are not checked on
    full sets. `leaf`, `depth` and the block sizes (documents, and shingles where sets are compared)
    bound the work of one task, not the result.

    A null or blank text has no shingles: its row stays alone, kept, and component_id is its doc_id.
    A text with fewer words than a shingle is one shingle. Rows that repeat a doc_id are one node,
    whatever their texts. A row with null doc_id links with nothing, component_id null, kept true.
    Other columns are ignored. No rows give no rows.
    """
    similarity = percent / 100
    sets = cut(_sketched(docs, words).withColumn("row", F.monotonically_increasing_id()))
    usable = sets.where("set_hash is not null and doc_id is not null")
    # One row stands for each distinct set, however often rows repeat; inside, its number is the node.
    keys = cut(usable.groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.min_by("row", "doc_id").alias("id")))
    # A partition for each 200,000 paths is enough between shuffles, however many the session's default deals.
    n = keys.count()
    parts = max(1, -(-n * trees // 200_000))
    reps = cut(sets.select(F.col("row").alias("id"), "set_hash", "n_shingles", "tokens", "sketch").join(keys.select("id", "doc"), "id"))

    def sketches(dealt: DataFrame) -> DataFrame:
        # The low byte of each value goes with every row of a leaf: unlike values agree in it once in 256, equal ones never differ.
        brief = F.concat(*[_value(i, 1) for i in range(SKETCH)])
        return dealt.join(reps.select("id", brief.alias("brief"), "n_shingles"), "id")

    def by_sketch(batch: pa.RecordBatch) -> np.ndarray:
        rows = batch.column(batch.schema.get_field_index("brief")).to_pylist()
        sizes = batch.column(batch.schema.get_field_index("n_shingles")).to_numpy(zero_copy_only=False)
        return _sketch_matrix(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, SKETCH), sizes, similarity)

    nodes, _ = _leaves(reps.select("id", "tokens", F.col("id").alias("cls")), range(2), leaf, min(depth, 2), parts, block, False)
    quick = _blocked(nodes, sketches, by_sketch, parts, exhaustive=False)
    known = checked_broadcast(connected_components(quick).select(F.col("node").alias("id"), F.col("component").alias("cls")))
    classed = cut(reps.select("id", "tokens").join(known, "id", "left").withColumn("cls", F.coalesce("cls", "id")))
    nodes, pairs = _leaves(classed, range(2, 2 + trees), leaf, depth, parts, block, True)
    links = quick.unionByName(_blocked(nodes, sketches, by_sketch, parts, more=None if pairs is None else _by_pairs(pairs)))
    candidates = connected_components(links).select(F.col("component").alias("grp"), F.col("node").alias("id"))

    def by_set(batch: pa.RecordBatch) -> np.ndarray:
        return _set_matrix([np.frombuffer(x, dtype=np.uint64) for x in batch.column(batch.schema.get_field_index("members")).to_pylist()], percent)

    # Only groups that do not fit a block need their size.
    weighed = cut(candidates.join(reps.select("id", "doc", "set_hash", "n_shingles"), "id").withColumn("w", F.lit(1.0 / set_block) + F.col("n_shingles") / F.lit(float(block_shingles))))
    large = checked_broadcast(weighed.groupBy("grp").agg(F.sum("w").alias("fill")).where("fill > 1"))
    grouped = cut(weighed.select("grp", "id", "w").join(large, "grp", "left").withColumn("fill", F.coalesce("fill", F.lit(1.0))))
    named_sets = weighed.select("id", "doc", "set_hash")

    def full_sets(dealt: DataFrame) -> DataFrame:
        return dealt.join(named_sets, "id").join(_sets_of(docs, named_sets, words), ["doc", "set_hash"])

    def kept_sets(large: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Rounds after the first concern large groups only: their sets are made once more and kept."""
        ids = cut(named_sets.join(large.select("id"), "id", "left_semi"))
        held = cut(ids.join(_sets_of(docs, ids, words), ["doc", "set_hash"]).select("id", "members"))
        return lambda dealt: dealt.join(held, "id")

    whole = reps.select("id", F.concat(*[_value(i, 2) for i in range(SKETCH)]).alias("sketch"))
    confirmed = _blocked(grouped, full_sets, by_set, None, reps=whole, levels=12, later=kept_sets)
    named = reps.select("id", "doc")
    by_doc = confirmed.join(named.select(F.col("id").alias("a"), F.col("doc").alias("da")), "a").join(named.select(F.col("id").alias("b"), F.col("doc").alias("db")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    # A doc_id of several texts joins what each of them links to.
    several = usable.groupBy("doc_id").agg(F.min(F.xxhash64("set_hash")).alias("lo"), F.max(F.xxhash64("set_hash")).alias("hi")).where("lo <> hi").select("doc_id")
    if not several.isEmpty():
        by_doc = by_doc.unionByName(usable.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(keys.select("set_hash", "doc"), "set_hash").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    found = connected_components(by_doc)

    by_set_hash = keys.join(found, F.col("doc") == F.col("node"), "left").select("set_hash", F.coalesce("component", "doc").alias("component_id")).coalesce(parts)
    result = sets.select("doc_id", "n_shingles", "set_hash").join(by_set_hash, "set_hash", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
