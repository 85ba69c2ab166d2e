"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word n-grams.

Items are cut into windows of n words (an item of fewer words is one window). They are broadcast as
sorted arrays, in blocks of a bounded number of words: a larger benchmark gets one narrow pass for each
block, whose broadcast is destroyed before the next, without a shuffle of the documents. Each document's
windows are looked up by a vectorised rolling hash, every hit is verified word by word, and the words
under verified windows are marked.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import cut, map_batches, texts_of, with_fields

# Words: digits, lower-cased A-Z and everything beyond ASCII; all other ASCII divides them.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """Windows of a block of items, by length: the distinct ones in the order of their hashes, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item_id for item_id, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            size = min(n, len(ids))
            if size:
                windows, owners = found.setdefault(size, ([], []))
                windows.append(np.lib.stride_tricks.sliding_window_view(ids, size).copy())
                owners.append(np.full(len(ids) - size + 1, number[item_id], dtype=np.int32))
        # size -> (hashes, windows, first place in `of`, of: item numbers); window k has the items of[first[k] : first[k + 1]].
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (windows, owners) in found.items():
            rows = np.unique(np.column_stack([np.concatenate(windows), np.concatenate(owners)]), axis=0)
            new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
            first = np.append(np.flatnonzero(new), len(rows))
            hashes = self._rolled(rows[new, :-1], size)[:, 0]
            order = np.argsort(hashes, kind="stable")
            spans = [rows[first[k] : first[k + 1], -1] for k in order]
            self.tables[size] = (hashes[order], np.ascontiguousarray(rows[new, :-1][order]), np.concatenate([[0], np.cumsum([len(x) for x in spans])]), np.concatenate(spans))

    @staticmethod
    def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all windows of `size` along the last axis."""
        x = ids.astype(np.uint64) + np.uint64(1)
        n = x.shape[-1] - size + 1
        out = np.zeros((*x.shape[:-1], n), dtype=np.uint64)
        for i in range(size):
            out = out * _MULTIPLIER + x[..., i : i + n]
        return out

    def find(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Mask of the words under verified windows (None without any) and the items found."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        mask, found = None, set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, windows, first, of) in self.tables.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])  # windows of known words only
            if not len(starts):
                continue
            rolled = self._rolled(ids, size)[starts]
            at = np.searchsorted(hashes, rolled)
            hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == rolled)
            for start, h, k in zip(starts[hit].tolist(), rolled[hit], at[hit].tolist(), strict=True):
                while k < len(hashes) and hashes[k] == h:
                    if (windows[k] == ids[start : start + size]).all():
                        if mask is None:
                            mask = np.zeros(len(ids), dtype=bool)
                        mask[start : start + size] = True
                        found.update(self.names[i] for i in of[first[k] : first[k + 1]].tolist())
                    k += 1
        return mask, found


def _blocks(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    """The benchmark's items, in as many parts (by a hash of item_id) as keep each below about max_words."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    # Bytes bound the words from above: a word and its divider take two at least.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // (2 * max_words)))
    items = cut(items) if parts > 1 else items
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, max_words: int = 1_000_000) -> DataFrame:
    """docs(text, ...) -> the same columns plus n_words long, hits array<int> (start, end, start, end, ... in words) and items array<string>.

    benchmark(item_id, text): its windows of n words, or the whole of a shorter item. A word of the
    document is hit if it lies in any occurrence of a window. Null texts have no words. Benchmark rows
    with null id or text are ignored; several rows of one item_id are one item. Every input row gives
    one row; input columns with these names are replaced. A block holds max_words words of the benchmark
    at most (or one longer item): about 60 bytes each, in each Python worker.
    """
    base = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*base)
    blocks = _blocks(benchmark, max_words)
    for part in blocks:
        items = sorted((r.item_id, r.text) for r in part.collect())  # bounded by max_words
        shared = docs.sparkSession.sparkContext.broadcast(Windows(items, n))
        where = out.columns.index("text")
        again = "hits" in out.columns

        def run(batch: pa.RecordBatch, shared=shared, where=where, again=again) -> pa.RecordBatch:
            counts, hits, items = [], [], []
            before = batch.column(batch.schema.get_field_index("hits")).to_pylist() if again else [[]] * batch.num_rows
            known = batch.column(batch.schema.get_field_index("items")).to_pylist() if again else [[]] * batch.num_rows
            for text, old, had in zip(texts_of(batch), before, known, strict=True):
                words = words_of(text)
                mask, found = shared.value.find(words)
                for i in range(0, len(old), 2):
                    mask = np.zeros(len(words), dtype=bool) if mask is None else mask
                    mask[old[i] : old[i + 1]] = True
                counts.append(len(words))
                hits.append([] if mask is None else np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist())
                items.append(sorted(found | set(had)))
            kept = batch.columns[: len(base)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(counts, type=pa.int64()), pa.array(hits, type=pa.list_(pa.int32())), pa.array(items, type=pa.list_(pa.string()))], names=[*base, "n_words", "hits", "items"])

        schema = with_fields(docs.select(*base), "n_words long, hits array<int>, items array<string>")
        out = map_batches(out, run, schema)
        if len(blocks) > 1:
            # Run this block's pass before the next begins, so that executors and workers hold one block at a time.
            out = cut(out)
            shared.destroy()
    return out


def hit_words() -> F.Column:
    """How many words the `hits` column covers."""
    return F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, remove: str = "documents", max_words: int = 1_000_000) -> DataFrame:
    """docs without contamination, same columns: `documents` drops each document with a hit, `spans` cuts the hit words out of its text.

    Null and empty texts have no hits and stay as they are; repeated rows are treated alike; columns named
    n_words, hits or items keep their values.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    own = {c: f"_own_{c}" for c in ("n_words", "hits", "items") if c in docs.columns}
    docs = docs.withColumnsRenamed(own)
    back = {new: old for old, new in own.items()}
    marked = mark_contamination(docs, benchmark, n=n, max_words=max_words)
    if remove == "documents":
        return marked.where("cardinality(hits) = 0").select(*docs.columns).withColumnsRenamed(back)
    names = docs.columns
    where = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cleaned = []
        for text, hits in zip(batch.column(where).to_pylist(), batch.column(batch.schema.get_field_index("hits")).to_pylist(), strict=True):
            if hits:
                raw = text.encode("utf-8", "surrogatepass")
                spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
                at, kept = 0, []
                for i in range(0, len(hits), 2):
                    kept.append(raw[at : spans[hits[i]][0]])
                    at = spans[hits[i + 1] - 1][1]
                text = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
            cleaned.append(text)
        return pa.RecordBatch.from_arrays([pa.array(cleaned, type=pa.string()) if i == where else batch.column(i) for i in range(len(names))], names=names)

    return map_batches(marked, run, docs.schema).withColumnsRenamed(back)
