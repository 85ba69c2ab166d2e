"""The Merkle manifest against a plain recursive one, over edge cases and several rounds."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tickwise.llm.merkle import down_sweep, fold, lowered, manifest, up_sweep

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The levels from the nodes to one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, i):
    for level in levels[:-1]:
        run = i - i % 8
        yield level[run:i], level[i + 1 : run + 8]
        i //= 8


def brute(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars, _ in rows:
        fake = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        trees.setdefault(b"" if lang is None else b":" + lang.encode(), []).append((-1 if doc_id is None else doc_id, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, fake, lang, source, n_chars), doc_id))
    names = sorted(trees)
    levels = {k: climb([x[1] for x in sorted(v, key=lambda x: x[:2])]) for k, v in trees.items()}
    top = climb([levels[k][-1][0] for k in names])
    out = []
    for k in names:
        for i, (_, own, fake, doc_id) in enumerate(sorted(trees[k], key=lambda x: x[:2])):
            sides = [*proof(levels[k], i), *proof(top, names.index(k))]
            end = fake
            for left, right in sides:
                end = H(*left, end, *right)
            out.append((doc_id, own, levels[k][-1][0], top[-1][0], H(*[d for left, right in sides for d in (*left, *right)]), end, end == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, levels):
    docs = spark.createDataFrame(rows, SCHEMA)
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered(F.col("text")))
    got = manifest(docs, forged=forged, levels=levels)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


MIXED = [
    *[(i, f"Text {i} É", "en", f"s{i % 3}", i, "x") for i in range(200)],
    *[(7, "Same row", "en", None, 3, None)] * 20,
    (None, None, None, None, None, None),
    (None, "", None, "a", 0, ""),
    (2**40, "x" * 100_000 + "Ä", "de", "a:b", None, "r"),
    *[(1000 + i, "Only", f"l{i}", None, None, None) for i in range(9)],
]


@pytest.mark.parametrize(("rows", "levels"), [(MIXED, 1), (MIXED, 2), (MIXED, 3), (MIXED[:1], 3), ([(1, "A", "en", "s", 1, ""), (2, "B", "de", "s", 1, "")], 3), (MIXED[:65], 1)])
def test_manifest_equals_brute_force(spark, rows, levels):
    rows = list(rows)
    random.Random(5).shuffle(rows)
    assert found(spark, rows, levels) == brute(rows)


def test_no_rows(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sweeps_of_one_block():
    leaves = [sha256(bytes([i])).digest() for i in range(100)]
    levels = up_sweep(leaves, 3)
    assert [len(x) for x in levels] == [100, 13, 2, 1]
    assert levels[-1][0].hex() == climb([d.hex() for d in leaves])[-1][0]
    tails = down_sweep(levels, b"")
    assert {fold(d, t) for d, t in zip(leaves, tails, strict=True)} == {levels[-1][0]}
    assert fold(leaves[1], tails[0]) != levels[-1][0]


def test_lowered_touches_ascii_only(spark):
    assert [r[0] for r in spark.createDataFrame([("AÉz",), ("é",), (None,)], "t string").select(lowered(F.col("t"))).collect()] == ["aÉz", "é", None]
