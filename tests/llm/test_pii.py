"""Personal data: base rules against their patterns, the lattice against all its paths, accuracy on values left out."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tickwise.llm import entry, pii
from tickwise.llm.pii import KINDS, Lattice, Model, base_spans, find_pii, fit, islands_of, luhn, redact_pii, scan, training_rows

SCHEMA = "doc_id long, text string, lang string, pii string"


@pytest.fixture(scope="module")
def model():
    return fit(training_rows(["the cat sat on a mat and went home", "order 12345678 was sent"], seed=3, generated=120))


def rules(text):
    """The base rules, written out again."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == 2 and 14 <= len(d) <= 19 and luhn(d)) or (kind == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), kind, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    fixed = ["a@b.c@d.e", "a@b.c_d@e.f", "@b.c", "a@@b.c", "x.y@z", "é@b.c a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "0001.2.3.4", "+1.2.3.4", "+49 30 1234567 +1", "4524 1322-6465 2876", "+4111111111111111", "4111111111111111 4111111111111111", "1" * 5000, "+1" + " " * 3000, "a" * 3000 + "@", "1." * 2000]
    for text in [*fixed, *("".join(r.choices(["@", ".", "-", "+", " ", "(", ")", "1", "25", "4111111111111111", "0", "a", "bc", "é", "_", "%", ","], k=r.randrange(1, 40))) for _ in range(3000))]:
        assert base_spans(text) == rules(text), text


def paths(lattice):
    """All paths: lists of (segment, kind before)."""

    def go(p, y):
        if p == len(lattice.points) - 1:
            yield []
        else:
            for rest in go(p + 1, y if lattice.gap(p) else 0):
                yield rest
        for i, q, kind in lattice.arcs[p]:
            for rest in go(q, kind):
                yield [(i, y, kind), *rest]

    return list(go(0, 0))


@pytest.mark.parametrize("text", ["a 30 1234567 12 b", "x@y.de +1 234 567 8901 12.3.4.5", "1 23 456 7890 12 345"])
def test_best_path_and_chances_equal_all_paths(text):
    lattice = Lattice(text, islands_of(text), base_spans(text))
    r = random.Random(8)
    model = Model({n: r.uniform(-1, 1) for names in lattice.names for n in names}, np.array([[r.uniform(-1, 1) for _ in range(5)] for _ in range(5)]))
    score = [model.score(x) for x in lattice.names]
    every = paths(lattice)
    total = [sum(score[i] + model.steps[y, kind] for i, y, kind in p) for p in every]
    best = every[int(np.argmax(total))]
    assert [x[:3] for x in model.best(lattice)] == [lattice.segments[i] for i, *_ in best]
    weight = np.exp(np.array(total)) / np.exp(total).sum()
    chance, steps = pii._expected(model, lattice, score)
    for i in range(len(score)):
        assert chance[i] == pytest.approx(sum(w for w, p in zip(weight, every, strict=True) if any(j == i for j, *_ in p)))
    for y, kind in itertools.product(range(5), range(1, 5)):
        assert steps[y, kind] == pytest.approx(sum(w * sum((a, b) == (y, kind) for _, a, b in p) for w, p in zip(weight, every, strict=True)))


def test_values_left_out_of_the_training(model):
    rows = training_rows(["another window of plain words that nobody saw"], seed=99, generated=60)
    right = wrong = lost = 0
    for text, labels in rows:
        got = {x[:3] for x in scan(text, model)}
        right += len(got & set(labels))
        wrong += len(got - set(labels) - set(base_spans(text)))
        lost += len(set(labels) - got)
    assert right > 300 and wrong / right < 0.05 and lost / (right + lost) < 0.12, (right, wrong, lost)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("call me at (269) 555-3296 now", "phone", "(269) 555-3296"),
        ("write to joe.doe at example dot com please", "email", "joe.doe at example dot com"),
        ("joe [at] mail (dot) org", "email", "joe [at] mail (dot) org"),
        ("up on 10[.]2[.]3[.]44 since", "ip", "10[.]2[.]3[.]44"),
        ("paid with 4111.1111.1111.1111 today", "card", "4111.1111.1111.1111"),
    ],
)
def test_the_model_adds_what_the_patterns_miss(model, text, kind, value):
    assert base_spans(text) == []
    assert [(k, text[s:e], b) for k, s, e, b, _ in scan(text, model)] == [(kind, value, False)]


def test_ordinary_numbers_stay(model):
    for text in ("dated 2019-04-03 12:30 and 2020-01-01", "pi is 3.14159265358979", "population 12 345 678", "ISBN 978-3-16-148410-0 in print", "on 12 34 56 78 times", "4524 1322 6465 2877", "the years 1914-1918 1939-1945", "look at home dot"):
        assert scan(text, model) == [], text


def test_find_and_redact_edge_cases(spark, model):
    texts = [None, "", "no data", "a@b.de and +49 30 1234567", "(269) 555-3296 é 1.2.3.4", "9 " * 20_000, "x" * 50_000 + "@y.z", "a@b.de and +49 30 1234567"]
    docs = spark.createDataFrame([(i if i else None, t, None, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id or 0: r for r in find_pii(docs, model=model).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in rows[i].pii if s.base] == rules(t or "")
    assert rows[0].pii == [] and [s.kind for s in rows[4].pii] == ["phone", "ip"]
    clean = {r.doc_id or 0: r.text for r in redact_pii(docs, model=model).collect()}
    assert clean[0] is None and clean[2] == "no data" and clean[3] == "[EMAIL] and [PHONE]" and clean[4] == "[PHONE] é [IP]"
    assert find_pii(docs.limit(0)).collect() == []


def test_query_columns(spark, tmp_path, model):
    texts = ["a@b.de 1.2.3.4", None, "(269) 555-3296"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(entry.op12_pii(spark, str(tmp_path)).collect())
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(1, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert rows[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].spans == "email:0:6,ip:7:14" and rows[1].spans == "" and rows[2].spans == "phone:0:14"
