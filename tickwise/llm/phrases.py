"""Phrase collocations of a corpus by SON partitioning: exact counts from shards mined at lowered support.

A phrase with `support` occurrences in a language has its share of them, by words, in one shard of the
documents at least. So every shard is mined completely at the proportionally lowered support (level by
level: words, pairs, then runs of surviving pairs), the phrases frequent in any shard are united, and all
of these candidates are counted over all documents.

Shards are a fixed number of parts by a hash of doc_id: the lowered support must not fall to one as the
corpus grows, as it would with a shard a task. A shard therefore spans many tasks; its counts are summed by
a shuffle of 64-bit hashes. Candidates travel to the tasks as a Bloom filter of bounded size; a wrong bit costs
one more phrase in the exact count, which is made of the phrases' words, and loses none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import checked_broadcast, cut, map_groups, mix64

LONGEST = 5
UNKNOWN = "und"
_UPPER = bytes(range(65, 91))
# Words end at a blank or tab, pieces at the rest; a byte that no UTF-8 text holds stands for the latter.
_END = 0xFF
_PIECES = bytes.maketrans(_UPPER + b"\t.,;:!?\n\v\f\r", _UPPER.lower() + b" " + bytes([_END]) * 10)
_WORDS = bytes.maketrans(_UPPER + b"\t.,;:!?\n\v\f\r" + bytes([_END]), _UPPER.lower() + b" " * 12)
_AHEAD = re.compile(rb"(?:[ \xff]*[^ \xff]+){0,%d}" % (LONGEST - 1))
_GAP = re.compile(rb"[ \xff]")
SLICE = 1 << 21
# Of the exact count: bytes of a part (smaller, as a task holds its sums as well), bytes of sums that a task holds, and words that it reads, about.
COUNTED = 1 << 19
HELD = 1 << 25
TASK_WORDS = 1 << 28
_FACTOR, _INVERSE = np.uint64(0x9E3779B97F4A7C13), np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (1 << 16))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f)])) for f in (_FACTOR, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of translated text: the start of each word, the number of its piece, and a hash of the word."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = np.concatenate([[True], (b == 32) | (b == _END), [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    powers, inverse = _powers_of(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * powers, dtype=np.uint64)])
    pieces = np.cumsum(b == _END)
    return starts, pieces[starts], mix64((sums[ends] - sums[starts]) * inverse[starts])


def salt_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` neighbouring words."""
    n = max(0, len(words) - size + 1)
    out = words[:n]
    for j in range(1, size):
        out = mix64(out * _FACTOR + words[j : n + j])
    return out


PROBES = 3


class Bits:
    """A Bloom filter: PROBES bits for each hash; every member is found, others rarely."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        rows, at, step = np.arange(len(keys)), keys & self.mask, (keys >> np.uint64(32) | np.uint64(1)) & self.mask
        for _ in range(PROBES):
            hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            rows, step = rows[hit], step[hit]
            at = (at[hit] + step) & self.mask
        found[rows] = True
        return found


def bits_of(keys: DataFrame, most: int = 1 << 30) -> Bits:
    """The filter of keys(key long): 16 bits a row, a power of two, and no more than `most` bits (128 MB)."""
    keys = cut(keys)
    size = 1 << max(20, min(most.bit_length() - 1, (16 * keys.count() - 1).bit_length()))
    part = 1 << 18

    def fill(group: pa.RecordBatch) -> dict:
        at = group.column(group.schema.get_field_index("at")).to_numpy() & (part - 1)
        got = np.zeros(part, bool)
        got[at] = True
        return {"part": [group.column(0)[0].as_py()], "bits": [np.packbits(got, bitorder="little").tobytes()]}

    # Masked before they are added, so that no sum leaves 64 bits.
    step = F.shiftrightunsigned("key", 32).bitwiseOR(1).bitwiseAND(size - 1)
    probes = keys.select(F.explode(F.array(*[(F.col("key").bitwiseAND(size - 1) + step * i).bitwiseAND(size - 1) for i in range(PROBES)])).alias("at"))
    dealt = probes.select(F.floor(F.col("at") / part).alias("part"), "at").distinct()
    bits = np.zeros(size // 8, np.uint8)
    # The parts are bounded by the bitmap's size, however many keys there are.
    for row in map_groups(dealt, ["part"], fill, pa.schema([("part", pa.int64()), ("bits", pa.binary())]), "part long, bits binary").collect():
        bits[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(row.bits, np.uint8)
    return Bits(bits)


def slices(data: bytes, size: int | None = None) -> Iterator[tuple[bytes, int]]:
    """(part, limit) of translated text: parts of about `size` bytes (unset: SLICE) that end at a gap, with the words that a phrase begun before limit may need."""
    begin, size = 0, size or SLICE
    while len(data) - begin > size:
        gap = _GAP.search(data, begin + size)
        if gap is None:
            break
        yield data[begin : _AHEAD.match(data, gap.start()).end()], gap.start() - begin
        begin = gap.start()
    yield data[begin:], len(data) - begin


def _chunks(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], table: bytes, size: int) -> Iterator[tuple[tuple, bytes, int]]:
    """(key, part, limit): the texts of a task by their keys, joined to parts of bounded size; null texts are left out."""
    held: dict[tuple, list[bytes]] = {}
    sizes: Counter = Counter()

    def flush(key: tuple) -> Iterator[tuple[tuple, bytes, int]]:
        del sizes[key]
        for part, limit in slices(bytes([_END]).join(held.pop(key)).translate(table), size):
            yield key, part, limit

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys]
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        for at, key in enumerate(zip(*columns, strict=True)):
            text = texts[at].as_py()
            if text:
                held.setdefault(key, []).append(text)
                sizes[key] += len(text)
                if sizes[key] >= size:
                    yield from flush(key)
        if sum(sizes.values()) >= 8 * size or len(held) > 1000:
            for key in list(held):
                yield from flush(key)
        del batch, columns, texts  # before the next one is read
    for key in list(held):
        yield from flush(key)


def _mapped(df: DataFrame, keys: tuple[str, ...], table: bytes, fn: Callable[[tuple, bytes, int], dict | None], schema: pa.Schema, ddl: str, size: int = SLICE, together: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, limit in _chunks(batches, keys, table, size):
            got = fn(key, part, limit)
            if got is not None and len(got[schema.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(made(batches))

    return df.mapInArrow(run, ddl)


def _counted_words(docs: DataFrame) -> DataFrame:
    """(lang, shard, word, n): the words of a language with a null shard, and the number of words of each shard with a null word."""

    def count(key: tuple, part: bytes, limit: int) -> dict:
        found = Counter(part[:limit].split())
        words = pa.array(list(found), pa.binary()).cast(pa.string()).to_pylist()
        n = len(words) + 1
        return {"lang": [key[0]] * n, "shard": [key[1], *[None] * (n - 1)], "word": [None, *words], "n": [sum(found.values()), *found.values()]}

    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    rows = _mapped(docs, ("lang", "shard"), _WORDS, count, schema, "lang string, shard int, word string, n long")
    return cut(rows.groupBy("lang", "shard", "word").agg(F.sum("n").alias("n")))


def word_keys(words: DataFrame) -> DataFrame:
    """words(lang, word) -> (key long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                salts = {lang: salt_of(lang) for lang in set(batch.column(0).to_pylist())}
                salt = np.array([salts[x] for x in batch.column(0).to_pylist()], np.uint64)
                _, _, hashes = hashed_words(b" ".join(batch.column(1).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(mix64(hashes + salt).view(np.int64))], names=["key"])

    return words.select("lang", "word").mapInArrow(run, "key long")


def _mined(docs: DataFrame, sizes: tuple[int, ...], known: int, bits: Bits, lowered: DataFrame) -> DataFrame:
    """Keys of the phrases of these sizes that a shard has often enough; docs(lang, share, text), lowered(share, least, need).

    A phrase counts only where all its parts of `known` words are in the bitmap. Shards that do not have it
    often enough have it least - 1 times at most: where even that, with the others' counts, stays below
    the support, it is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def mine(key: tuple, part: bytes, limit: int) -> dict | None:
        lang, share = key
        starts, pieces, words = hashed_words(part)
        salt = salt_of(lang)
        good = shared.value.has(mix64(phrase_hashes(words, known) + salt))
        found, counts = [], []
        for size in sizes:
            n = len(words) - size + 1
            if n <= 0:
                continue
            open_ = (pieces[:n] == pieces[size - 1 :]) & (starts[:n] < limit)
            for j in range(size - known + 1):
                open_ &= good[j : n + j]
            keys, c = np.unique(mix64(phrase_hashes(words, size)[open_] + salt), return_counts=True)
            found.append(keys.view(np.int64))
            counts.append(c)
        if not found:
            return None
        keys = np.concatenate(found)
        return {"share": np.full(len(keys), share, np.int64), "key": keys, "n": np.concatenate(counts)}

    schema = pa.schema([("share", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
    rows = _mapped(docs, ("lang", "share"), _PIECES, mine, schema, "share long, key long, n long")
    often = rows.groupBy("share", "key").agg(F.sum("n").alias("n")).join(lowered, "share").where("n >= least")
    return often.groupBy("key").agg(F.sum(F.col("n") - F.col("least") + 1).alias("over"), F.min("need").alias("need")).where("over >= need").select("key")


def summed(batches: Iterable[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Batches (lang, phrase, n), with the counts of a phrase added up; whenever the sums come to `held` bytes they are handed on."""
    waiting: list[pa.RecordBatch] = []
    size = known = 0

    def sums() -> pa.Table:
        got = pa.Table.from_batches(waiting).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return pa.table({"lang": got["lang"], "phrase": got["phrase"], "n": got["n_sum"]})

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        # Added up when as much is new as is known, so that no row is taken often.
        if size >= 2 * known + held // 8:
            waiting = sums().to_batches()
            size = known = sum(x.nbytes for x in waiting)
            if known >= held:
                yield from pa.Table.from_batches(waiting).to_batches(max_chunksize=1 << 16)
                waiting, size, known = [], 0, 0
    if waiting:
        yield from sums().to_batches(max_chunksize=1 << 16)


def _counted_phrases(docs: DataFrame, pairs: Bits, longer: Bits, tasks: int | None = None) -> DataFrame:
    """(lang, phrase, a): exact occurrences of every candidate, and of the few others whose bit is set.

    A phrase has a row for each task, not for each part of its text: phrases and parts both grow with the
    input, and rows as their product. So a task adds up its parts, and there are `tasks` of them at most
    (unset: as many as cores), each of many splits.
    """
    docs = docs.coalesce(tasks or docs.sparkSession.sparkContext.defaultParallelism)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, longer))

    def count(key: tuple, part: bytes, limit: int) -> dict | None:
        (lang,) = key
        starts, pieces, hashes = hashed_words(part)
        tokens = part.translate(_WORDS).split()
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens), np.int64, len(tokens))
        two, more = shared.value
        salt = salt_of(lang)
        here = two.has(mix64(phrase_hashes(hashes, 2) + salt)) & (pieces[:-1] == pieces[1:])
        phrases, counts = [], []
        codes, at = words, np.flatnonzero(here & (starts[:-1] < limit))
        for size in range(2, LONGEST + 1):
            if size > 2:
                # All parts of a frequent phrase are candidates: one goes on where it did without its last word and its last two go on.
                at = at[at + size <= len(words)]
                at = at[here[at + size - 2]]
                at = at[more.has(mix64(phrase_hashes(hashes, size)[at] + salt))]
            # Exact numbers of the phrases of this size: that of the phrase without its last word, and the last word.
            _, first, inverse, c = np.unique(codes[at] * np.int64(len(numbers)) + words[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            phrases += [b" ".join(tokens[i : i + size]) for i in at[first].tolist()]
            counts.append(c)
            codes = np.zeros(len(words), np.int64)
            codes[at] = inverse
        if not phrases:
            return None
        return {"lang": [lang] * len(phrases), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": np.concatenate(counts)}

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    rows = _mapped(docs, ("lang",), _PIECES, count, schema, "lang string, phrase string, n long", COUNTED, summed)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def frequent_phrases(docs: DataFrame, *, support: int = 100, shards: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text, lang) -> words(lang, word, n), phrases(lang, phrase, size, a), totals(lang, n).

    Words and phrases of 2 to LONGEST words that occur `support` times or more in their language, counted
    exactly over all texts.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "text").where("text is not null")
    counted = _counted_words(docs)
    parts = counted.where("word is null").select("lang", "shard", "n")
    totals = cut(parts.groupBy("lang").agg(F.sum("n").alias("n")))
    words = cut(counted.where(F.col("word").isNotNull() & (F.col("n") >= support)).select("lang", "word", "n"))
    # The lowered support of a shard, rounded up: support * words of the shard / words of the language.
    least = F.expr(f"(part * {int(support)} + n - 1) div n")
    shares = cut(parts.withColumnRenamed("n", "part").join(totals, "lang").where("part > 0").select("lang", "shard", F.xxhash64("lang", "shard").alias("share"), F.greatest(F.lit(1), least).alias("least")))
    # What a phrase's counts above least - 1 must come to over its shards.
    needed = shares.groupBy("lang").agg((F.lit(int(support)) - F.sum(F.col("least") - 1)).alias("need"))
    lowered = checked_broadcast(shares.join(needed, "lang").select("share", "least", "need"))
    dealt = docs.join(checked_broadcast(shares.select("lang", "shard", "share")), ["lang", "shard"])
    pairs = bits_of(_mined(dealt, (2,), 1, bits_of(word_keys(words)), lowered))
    longer = bits_of(_mined(dealt, tuple(range(3, LONGEST + 1)), 2, pairs, lowered))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(totals.agg(F.sum("n")).first()[0] or 0) // TASK_WORDS))
    phrases = cut(_counted_phrases(docs.select("lang", "text"), pairs, longer, tasks).where(F.col("a") >= support).withColumn("size", F.size(F.split("phrase", " "))))
    return words, phrases, totals


def _looked_up(rows: DataFrame, counts: DataFrame, totals: DataFrame, part: str, name: str) -> DataFrame:
    """rows with the count of their part; parts that make up a great share of a language, few by their number, meet them by broadcast."""
    named = counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    if counts.count() <= 500_000:
        return rows.join(F.broadcast(named), ["lang", part])
    # At most 2,000 phrases of each size have more than one in 2,000 of a language's words.
    large = counts.join(checked_broadcast(totals), "lang").where("a * 2000 > n").select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    hot = checked_broadcast(large)
    return rows.join(hot, ["lang", part]).unionByName(rows.join(hot, ["lang", part], "left_anti").join(named, ["lang", part]))


def collocations(docs: DataFrame, *, support: int = 100, most: int = 2000, shards: int = 5) -> DataFrame:
    """docs(doc_id, text, lang) -> (lang, rank, phrase, a, l, r, n, score): the `most` first of each language.

    Texts are taken with A-Z in lower case, cut into pieces at `.,;:!?` and line ends, and these into words
    at blanks and tabs; a null lang is `und`. a is the number of occurrences of the phrase, n that of all
    words; l and r are those of the two parts at the cut of least score, floor(1000 * a * n / (l * r)),
    ties to the shorter first part. Phrases that never occur outside one longer candidate are dropped. By
    score, then a, descending, then phrase. Null and empty texts, and words longer than any buffer, are
    taken as they are; repeated rows count each time; a table without rows gives none. Further columns are
    ignored. The counts do not hang on the number of shards.
    """
    words, phrases, totals = frequent_phrases(docs, support=support, shards=shards)
    counts = cut(phrases.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))))
    # A phrase goes if it occurs as often as one that has a word more; those with still more words occur less often.
    w = F.split("phrase", " ")
    inner = phrases.where("size > 2").select("lang", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase"), F.col("a").alias("longer"))
    kept = phrases.join(inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left").where("longer is null or longer < a")
    part = lambda first, size: F.array_join(F.slice(w, first, size), " ")
    cuts = cut(kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k")).select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size(w) - F.col("k")).alias("right")))
    cuts = _looked_up(_looked_up(cuts, counts, totals, "left", "l"), counts, totals, "right", "r").join(checked_broadcast(totals), "lang")
    big = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    # Exact: 1000 * a * n and l * r as decimals of 38 digits, divided whole.
    scored = cuts.withColumn("over", big("a", 16) * F.lit(1000).cast("decimal(4,0)") * big("n", 16)).withColumn("under", big("l", 18) * big("r", 18)).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranked in parts first, so that no task sorts a whole language.
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
