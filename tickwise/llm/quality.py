"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

1. Random indexing over the whole corpus: a token's vector is the sum of the sparse random index
   vectors of its neighbours. Tokens are runs of letters and digits or of signs; each has a word
   row (hashed) and a shape row (case, length, kind of sign), so that rare words still say something.
   Sums are integers, so the vectors do not depend on the order of tasks.
2. A document is pooled: mean of its token vectors, mean of their squares, and mean of the products
   of neighbours (high where a text repeats itself).
3. A numpy network with one hidden layer is fitted on a bounded sample of labelled rows; part of
   them is left out to fit the temperature of its probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import map_batches, mix64, one_text_each, texts_of, with_fields

WORD_ROWS, SHAPE_ROWS, DIM = 8192, 256, 64
ROWS = WORD_ROWS + SHAPE_ROWS
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_PIECE = 32_768  # tokens of a text summed in one go
_BLOCK = 2048  # tokens of short texts handled at once: their vectors stay in the processor's cache


def _shape(token: str) -> str:
    if not (token[0].isalnum()):
        return token[:3]
    if token.isdigit():
        return f"9{min(len(token), 8)}"
    kind = "u" if token.isupper() and len(token) > 1 else "t" if token[0].isupper() else "l" if token.islower() else "m"
    return f"{kind}{min(len(token) // 3, 6)}"


class _Tokens:
    """Token -> word row and shape row, packed into one number and remembered between documents."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _learn(self, token: str) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        word, shape = (xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in (token, _shape(token)))
        packed = self.known[token] = word % WORD_ROWS * SHAPE_ROWS + shape % SHAPE_ROWS + 1
        return packed

    def rows(self, text: str) -> np.ndarray:
        """(tokens, 2) rows of a text."""
        get, learn = self.known.get, self._learn
        packed = np.array([get(token) or learn(token) for token in _TOKEN.findall(text)], dtype=np.int64) - 1
        return np.stack([packed // SHAPE_ROWS, WORD_ROWS + packed % SHAPE_ROWS], axis=1)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Position and sign of each row's random index vector; a token's is that of its word plus that of its shape."""
    h = mix64(np.arange(1, ROWS + 1, dtype=np.uint64))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def context_sums(docs: DataFrame) -> DataFrame:
    """(row, sums array<long>): random-indexing sums of every row over the whole corpus."""
    fields = pa.schema([("row", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        tokens, (place, sign) = _Tokens(), _index_vectors()
        total = np.zeros(ROWS * DIM, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0

        def add() -> None:
            flat = np.concatenate(held)
            # A break row between documents keeps neighbours inside one text.
            one, two = flat[:-1], flat[1:]
            inside = (one[:, 0] >= 0) & (two[:, 0] >= 0)
            one, two = one[inside], two[inside]
            # Sums of +1 and -1: whole numbers, exact in doubles. One count over all pairs of rows makes one table of sums.
            pairs = [(a[:, i], b[:, j]) for a, b in ((one, two), (two, one)) for i in range(2) for j in range(2)]
            at = np.concatenate([target * DIM + place[context] for target, context in pairs])
            total[:] += np.bincount(at, weights=np.concatenate([sign[context] for _, context in pairs]), minlength=ROWS * DIM).astype(np.int64)

        for batch in batches:
            for text in texts_of(batch):
                rows = tokens.rows(text)
                for begin in range(0, len(rows), 200_000):
                    held += [rows[begin : begin + 200_000], np.full((1, 2), -1)]
                    n += len(held[-2])
                    if n >= 200_000:
                        add()
                        held, n = [], 0
        if n:
            add()
        full = np.flatnonzero(total.reshape(ROWS, DIM).any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, len(full) * DIM + 1, DIM, dtype=np.int32), pa.array(total.reshape(ROWS, DIM)[full].ravel()))], schema=fields)

    parts = docs.select("text").mapInArrow(run, "row int, sums array<long>")
    return parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIM)]).alias("sums"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM table, centred and of unit length; its size is fixed by the parameters above."""
    table = np.zeros((ROWS, DIM))
    got = context_sums(docs).toArrow()
    table[got.column("row").to_numpy()] = got.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    used = table.any(axis=1)
    if used.any():
        table[used] -= table[used].mean(axis=0)
        table[used] /= np.maximum(np.linalg.norm(table[used], axis=1, keepdims=True), 1e-9)
    return table.astype(np.float32)


def pool(token_rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """(documents, 3 * DIM) pooled vectors; a text without tokens is all zero."""
    out = np.zeros((len(token_rows), 3 * DIM))
    pieces = [(i, rows[b : b + _PIECE]) for i, rows in enumerate(token_rows) for b in range(0, len(rows), _PIECE)]
    begin = 0
    while begin < len(pieces):
        end, n = begin, 0
        while end < len(pieces) and (n == 0 or n + len(pieces[end][1]) <= _BLOCK):
            n += len(pieces[end][1])
            end += 1
        sizes = np.array([len(p) for _, p in pieces[begin:end]])
        flat = np.concatenate([p for _, p in pieces[begin:end]])
        vectors = table[flat[:, 0]] + table[flat[:, 1]]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        after = np.zeros_like(vectors)
        after[:-1] = vectors[:-1] * vectors[1:]
        after[starts[1:] - 1] = 0  # neighbours in two texts
        sums = np.concatenate([np.add.reduceat(x, starts, axis=0) for x in (vectors, vectors * vectors, after)], axis=1)
        np.add.at(out, [i for i, _ in pieces[begin:end]], sums)
        begin = end
    counts = np.array([max(1, len(r)) for r in token_rows])[:, None]
    return out / counts


@dataclass
class Network:
    """Standardised inputs -> ReLU layer -> one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the mean log loss; every fifth row is left out and fits the temperature by its log loss."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 and x.shape[1] else 3 * DIM
    if len(y) < 10 or y.min() == y.max():
        # Too little to learn from: the constant log odds of the labels, smoothed.
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    left = np.arange(len(y)) % 5 == 4
    tx, ty = x[~left].astype(np.float64), y[~left]
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-6, rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), float(np.log((ty.mean() + 1e-3) / (1 - ty.mean() + 1e-3))))
    tx -= net.mean
    tx /= net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ty))
        for begin in range(0, len(ty), 128):
            rows = order[begin : begin + 128]
            bx, by = tx[rows], ty[rows]
            h = bx @ params[0] + params[1]
            a = np.maximum(h, 0)
            err = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - by) / len(rows)
            back = np.outer(err, params[2]) * (h > 0)
            step += 1
            for i, g in enumerate((bx.T @ back + decay * params[0], back.sum(axis=0), a.T @ err + decay * params[2], np.array([err.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    z = net.logit(x[left].astype(np.float64))
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    net.temperature = float(grid[np.argmin([_loss(z / t, y[left]) for t in grid])])
    return net


def _pooled(docs: DataFrame, table: np.ndarray, keep: list[str], ddl: str) -> DataFrame:
    """docs with their pooled vectors as `pooled array<float>`."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    tokens = _Tokens()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pool([tokens.rows(t) for t in texts_of(batch)], shared.value).astype(np.float32)
        kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))], names=[*keep, "pooled"])

    return map_batches(docs.select(*keep, "text"), run, ddl)


def fit_quality(docs: DataFrame, labelled: DataFrame, table: np.ndarray, max_train: int = 20_000) -> Network:
    """labelled(doc_id, label 0/1): at most max_train of them, chosen by a hash of doc_id, are joined to their texts."""
    sample = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # One text for each sampled id, however often rows repeat it: no more than max_train rows reach the driver.
    rows = one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "label"])
    got = _pooled(rows, table, ["doc_id", "label"], "doc_id long, label double, pooled array<float>").toArrow().sort_by([("doc_id", "ascending")])
    order = np.random.default_rng(3).permutation(got.num_rows)
    x = got.column("pooled").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, 3 * DIM)[order]
    y = (got.column("label").to_numpy() >= 0.5).astype(np.float64)[order]
    del got
    net = fit_network(x, y)
    # The driver keeps neither the sample nor its buffers.
    del x
    pa.default_memory_pool().release_unused()
    return net


def quality_scores(docs: DataFrame, labelled: DataFrame, *, threshold: float = 0.3, max_train: int = 20_000) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, without clashes, plus score double and predicted int.

    score is the calibrated probability of label 1, from the text alone; predicted is 1 where it
    reaches the threshold. A null or empty text pools to zeros and gets the score of that vector.
    Labels that are null are ignored, several for one doc_id are averaged, and of rows that repeat a
    doc_id one text is learned from; with no usable labels
    (or one class only) the score is the smoothed share of label 1. Every input row gives one row;
    input columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)
    table = word_vectors(docs)
    net = fit_quality(docs, labelled, table, max_train)
    shared = docs.sparkSession.sparkContext.broadcast((table, net))
    tokens = _Tokens()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, model = shared.value
        score = model.score(pool([tokens.rows(t) for t in texts_of(batch)], vectors))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(docs, run, with_fields(docs, "score double, predicted int"))
