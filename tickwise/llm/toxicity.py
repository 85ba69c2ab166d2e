"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over the words of a text. A labelled text that names a group is paired with
copies in which each identity term is swapped for another of its kind; one that names none gets a term
put in, and is paired with the same text with another term of that kind. The squared difference of the
two scores is part of the loss, so that a group's name alone moves the score little.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut, map_batches, one_text_each, texts_of, with_fields

# Identity terms by kind; a term is swapped for the others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "autistic"),
    ("elderly", "young", "teenage"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swaps_of(words: set[str], terms=IDENTITY_TERMS, at: int = 0) -> list[tuple[set[str], set[str], set[str], set[str]]]:
    """Counterfactual pairs of a text, as (taken, put) of one side and (taken, put) of the other.

    Each kind's terms move one place, then two, ... within their row. Without any term, the row and the
    terms numbered by `at` are put in and compared.
    """
    out = []
    for shift in range(1, max(map(len, terms), default=0)):
        changed = set(words)
        for row in terms:
            found = [w for w in row if w in words]
            changed.difference_update(found)
            changed.update(row[(row.index(w) + shift) % len(row)] for w in found)
        pair = (set(), set(), words - changed, changed - words)
        if changed != words and pair not in out:
            out.append(pair)
    if not out and terms:
        row = terms[at % len(terms)]
        i, step = at // len(terms) % len(row), 1 + at // len(terms) // len(row) % (len(row) - 1)
        out.append((set(), {row[i]}, set(), {row[(i + step) % len(row)]}))
    return out


class SparseModel:
    """Vocabulary, a weight for each word, and a bias."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float) -> None:
        self.weights = {w: float(weights[i]) for w, i in vocabulary.items() if weights[i]}
        self.bias = bias

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _flat(sets) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of each entry of a list of word lists."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets).astype(np.int64) if len(sets) else np.empty(0, dtype=np.int64)), np.repeat(np.arange(len(sets)), sizes)


class Pairs:
    """Counterfactual pairs as changes of labelled rows: of = the row; each side a list of words with +1 (put in) or -1 (taken out)."""

    def __init__(self, of: list[int], sides: tuple[list[tuple[list[int], list[int]]], list[tuple[list[int], list[int]]]]) -> None:
        self.of = np.array(of, dtype=np.int64)
        self.sides = []
        for side in sides:
            word, row = _flat([[*taken, *put] for taken, put in side])
            sign = np.concatenate([[-1.0] * len(taken) + [1.0] * len(put) for taken, put in side]) if side else np.empty(0)
            self.sides.append((word, row, sign))

    def __len__(self) -> int:
        return len(self.of)


def objective(w: np.ndarray, b: float, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pairs: Pairs, swap_penalty: float) -> tuple[float, np.ndarray, float]:
    """Mean log loss + swap_penalty * mean squared score change of pairs, and its gradient in w and b."""
    n, width = len(y), len(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    z = b + np.bincount(x[1], weights=w[x[0]], minlength=n)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    pull = (sigmoid(z) - y) / n  # the gradient in each row's logit
    gw = np.zeros(width)
    if len(pairs):
        moved = [z[pairs.of] + np.bincount(row, weights=sign * w[word], minlength=len(pairs)) for word, row, sign in pairs.sides]
        s = [sigmoid(m) for m in moved]
        change = s[0] - s[1]
        loss += swap_penalty * float(np.mean(change * change))
        for (word, row, sign), score, direction in zip(pairs.sides, s, (1.0, -1.0), strict=True):
            d = direction * 2 * swap_penalty / len(pairs) * change * score * (1 - score)
            gw += np.bincount(word, weights=sign * d[row], minlength=width)
            pull = pull + np.bincount(pairs.of, weights=d, minlength=n)
    gw += np.bincount(x[0], weights=pull[x[1]], minlength=width)
    return loss, gw, float(pull.sum())


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, pairs: Pairs, width: int, *, shrink: float = 0.03, swap_penalty: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on objective() + shrink / rows * |w|."""
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return w, b
    x = _flat(rows)
    # Each word's own step: a bound of its curvature, by its share of rows and of pairs.
    curve = 0.25 * (np.bincount(x[0], minlength=width) / len(y)) + 1e-4
    for word, _, _ in pairs.sides if len(pairs) else ():
        curve += swap_penalty * 0.25 * np.bincount(word, minlength=width) / len(pairs)
    rate = 1 / (8 * curve)
    mw, mb, t = w.copy(), b, 1.0
    for _ in range(steps):
        _, gw, gb = objective(mw, mb, x, y, pairs, swap_penalty)
        nw = mw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * shrink / len(y), 0)
        nb = mb - 0.5 * gb
        if gw @ (nw - w) + gb * (nb - b) > 0:
            t = 1.0  # momentum points uphill: start it again
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_toxicity(docs: DataFrame, labelled: DataFrame, *, max_train: int = 20_000, max_ids: int = 20_000_000, min_docs: int = 3, max_words: int = 50_000, terms=IDENTITY_TERMS, swap_penalty: float = 10.0) -> SparseModel:
    """labelled(doc_id, label 0/1): at most max_train of them, by a hash of doc_id; words in min_docs of those texts, at most max_words by count.

    The driver holds max_ids word numbers at most (80 MB): of very long texts, fewer rows are learned from.
    """
    sample = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def to_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(words_of(t)) for t in texts_of(batch)], type=pa.list_(pa.string()))], names=["doc_id", "label", "words"])

    bags = cut(map_batches(one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "label"]), to_words, "doc_id long, label double, words array<string>"))
    identity = {w for row in terms for w in row}
    frequent = bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).orderBy(F.desc("n"), "word").limit(max_words)
    vocabulary = {w: i for i, w in enumerate(sorted({r.word for r in frequent.collect()} | identity))}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def to_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        lists = [[index[w] for w in words if w in index] for words in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, type=pa.list_(pa.int32()))], names=["doc_id", "label", "ids"])

    coded = cut(map_batches(bags, to_rows, "doc_id long, label double, ids array<int>"))
    # max_train rows at most: ids in the order of their hashes, as many as fit.
    held = coded.select("doc_id", (F.sum(F.size("ids")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).alias("before")).where(F.col("before") <= max_ids).select("doc_id")
    got = coded.join(F.broadcast(held), "doc_id").toArrow().sort_by([("doc_id", "ascending")])
    y = (got.column("label").to_numpy() >= 0.5).astype(np.float64)
    ids = got.column("ids").combine_chunks()
    edges = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)
    rows = [flat[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    number = {vocabulary[w]: w for w in identity}
    of, sides = [], ([], [])
    for i, row in enumerate(rows):
        named = {number[k] for k in row[np.isin(row, list(number))].tolist()} if number else set()
        for *one, taken, put in swaps_of(named, terms, at=i):
            of.append(i)
            for side, pair in zip(sides, (one, (taken, put)), strict=True):
                side.append(tuple(sorted(vocabulary[w] for w in words) for words in pair))
    weights, bias = fit_sparse(rows, y, Pairs(of, sides), len(vocabulary), swap_penalty=swap_penalty)
    return SparseModel(vocabulary, weights, bias)


def toxicity_scores(docs: DataFrame, labelled: DataFrame, *, threshold: float = 0.7, max_train: int = 20_000, terms=IDENTITY_TERMS, swap_penalty: float = 10.0) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, without clashes, plus score double and predicted int.

    score is the probability of label 1, from the text alone. A null or empty text has no words and
    gets the score of the bias. Null labels are ignored, several for one doc_id are averaged, and of rows that repeat a doc_id one
    text is learned from; with no
    usable labels, or one class only, every score is the smoothed share of label 1. Every input row
    gives one row; input columns named score or predicted are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labelled, max_train=max_train, terms=terms, swap_penalty=swap_penalty))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        score = np.array([model.score(t) for t in texts_of(batch)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(docs, run, with_fields(docs, "score double, predicted int"))
