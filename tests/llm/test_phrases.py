"""Phrase collocations against brute force over edge cases, and their parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tickwise.llm import phrases
from tickwise.llm.phrases import collocations, hashed_words, phrase_hashes, slices

SCHEMA = "doc_id long, text string, lang string, rank string, a string"


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
        yield re.findall("[^\x20\x09]+", piece)


def brute(rows, support, most):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for w in pieces_of(text):
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = {}
    for (lang, p), a in often.items():
        if any(o == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in often.items()):
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


def corpus():
    r = random.Random(4)
    words = ["The", "the", "of", "is-land", "é", "É", "a b", "x", "Zz", "\x00"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(1, 60))), r.choice(["en", "en", "en", "fr", None, ""]), "x", None) for i in range(120)]
    rows += [(500, "one long phrase that repeats. and again", "en", None, None)] * 30
    return rows + [(None, None, None, None, None), (1, "", "en", None, None), (2, ".,;:", "de", None, None), (3, "w " * 4000 + "y" * 50_000, "de", None, None), (None, "the of the of", "en", None, None)]


@pytest.mark.parametrize(("support", "most", "shards"), [(5, 2000, 5), (4, 7, 1), (30, 2000, 3)])
def test_collocations_equal_brute_force(spark, support, most, shards):
    rows = corpus()
    got = collocations(spark.createDataFrame(rows, SCHEMA), support=support, most=most, shards=shards).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute(rows, support, most)
    assert len(want) > 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_rows_and_no_words(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, "en", "", ""), (2, " . ", None, "", "")], SCHEMA), support=1).collect() == []


def test_products_beyond_64_bits(spark):
    # The same arithmetic as the query, on counts that no fixture can hold.
    a, n, left, right = 10**12, 9 * 10**12, 2 * 10**12, 10**12 + 7
    df = spark.range(1).selectExpr(f"cast({a} as decimal(16,0)) * cast(1000 as decimal(4,0)) * cast({n} as decimal(16,0)) as over", f"cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)) as under")
    assert df.selectExpr("over div under as s").first().s == 1000 * a * n // (left * right)


def test_slices_lose_and_double_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 64)
    r = random.Random(2)
    data = b"".join(r.choice([b"ab", b"c", b"d" * 90, "é".encode()]) + r.choice([b" ", b"  ", b"\xff", b" \xff "]) for _ in range(500))

    def grams(part, limit):
        starts, pieces, words = hashed_words(part)
        for k in range(2, 6):
            n = len(words) - k + 1
            if n > 0:
                yield from ((k, h) for h in phrase_hashes(words, k)[(pieces[:n] == pieces[k - 1 :]) & (starts[:n] < limit)].tolist())

    assert len(list(slices(data))) > 20
    assert Counter(g for s in slices(data) for g in grams(*s)) == Counter(grams(data, len(data)))


def test_word_hashes_know_words_not_places():
    _, _, one = hashed_words(b"ab ba ab \xff aab b")
    assert one[0] == one[2] and len(set(one.tolist())) == 4
    assert len(hashed_words(b" \xff ")[2]) == 0 and np.array_equal(hashed_words(b"xyz ab")[2][1:], one[:1])


def test_few_phrases_pass_that_are_not_frequent(spark):
    """The filter lets less than 1 % of others through, and a phrase that is often enough in one shard only goes no further."""
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 2 << 16)
    bits = phrases.bits_of(spark.createDataFrame([(int(k),) for k in keys[: 1 << 16]], "key long"))
    assert bits.has(keys[: 1 << 16].view(np.uint64)).all()
    assert bits.has(keys[1 << 16 :].view(np.uint64)).mean() < 0.01
    # Shards of 20 at least, and counts above 19 that must come to 5: 24 in one shard could be frequent, 23 could not.
    texts = {1: "a b," * 24 + "c d," * 23 + "e f," * 21 + "g h," * 19, 2: "e f," * 22 + "g h," * 19}
    docs = spark.createDataFrame([("en", share, text) for share, text in texts.items()], "lang string, share long, text string")
    lowered = spark.createDataFrame([(1, 20, 5), (2, 20, 5)], "share long, least long, need long")
    words = phrases.bits_of(phrases.word_keys(spark.createDataFrame([("en", w) for w in "abcdefgh"], "lang string, word string")))
    _, _, hashes = hashed_words(b"a b c d e f g h")
    named = dict(zip(phrases.mix64(phrase_hashes(hashes, 2) + phrases.salt_of("en")).view(np.int64).tolist(), ["a b", "b c", "c d", "d e", "e f", "f g", "g h"], strict=True))
    assert sorted(named[r.key] for r in phrases._mined(docs, (2,), 1, words, lowered).collect()) == ["a b", "e f"]


def rows_of_python(plan):
    """Rows that the MapInArrow nodes of an executed plan handed to Spark."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_of_python(plan.finalPhysicalPlan())
    if name.endswith("QueryStageExec"):
        return rows_of_python(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("pythonNumRowsReceived").value() if name == "MapInArrowExec" else 0
    return own + sum(rows_of_python(children.apply(i)) for i in range(children.size()))


def test_a_phrase_has_a_row_a_task_not_a_part(spark):
    """Twelve splits of two parts each: the exact count hands on each phrase once for each of four tasks at most."""
    text = "a b. c d. " * ((phrases.SLICE + phrases.SLICE // 2) // 10)
    docs = spark.range(12, numPartitions=12).selectExpr("'en' as lang", f"'{text}' as text")
    words = spark.createDataFrame([("en", "a"), ("en", "b"), ("en", "c"), ("en", "d")], "lang string, word string")
    _, _, hashes = hashed_words(b"a b c d")
    keys = phrases.mix64(phrase_hashes(hashes, 2) + phrases.salt_of("en")).view(np.int64).tolist()
    pairs = phrases.bits_of(spark.createDataFrame([(keys[0],), (keys[2],)], "key long"))
    counted = phrases._counted_phrases(docs, pairs, phrases.bits_of(phrases.word_keys(words)))
    assert sorted(tuple(r) for r in counted.collect()) == [("en", "a b", 12 * text.count("a b")), ("en", "c d", 12 * text.count("c d"))]
    assert rows_of_python(counted._jdf.queryExecution().executedPlan()) <= 4 * 2


@pytest.mark.parametrize("held", [1, 60, 1 << 20])
def test_sums_of_a_task_are_whole_however_little_is_held(held):
    r = random.Random(3)
    rows = [[(r.choice(["en", "de", ""]), r.choice(["a b", "é b", "a b c", "x" * 40 + " y"]), r.randrange(1, 9)) for _ in range(r.randrange(0, 7))] for _ in range(40)]
    schema = phrases.pa.schema([("lang", "string"), ("phrase", "string"), ("n", "int64")])
    batches = [phrases.pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in b], schema=schema) for b in rows]
    out = list(phrases.summed(batches, held))
    got, want = Counter(), Counter()
    for b in out:
        assert b.schema == schema
        for x in b.to_pylist():
            got[x["lang"], x["phrase"]] += x["n"]
    for lang, phrase, n in sum(rows, []):
        want[lang, phrase] += n
    assert got == want and list(phrases.summed([], held)) == []
    assert held < 1 << 20 or sum(b.num_rows for b in out) == len(want)
