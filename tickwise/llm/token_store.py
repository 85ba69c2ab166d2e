"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

File: zstd frames, then a skippable frame (magic 0x184D2A50) with the document index, then a skippable
frame (0x184D2A5E) in the seekable format: for each frame its compressed size, its size and the low 32
bits of XXH64 of its content, and a footer of 9 bytes (frames, descriptor, 0x8F92EAB1). All integers are
little-endian. Content of a frame: u32 n; n document ids, i64; n lengths, u32; the ids of all, u32.
Index entry of a frame: first and last document id i64, documents u32, token ids u64.
A null document id is stored as the smallest i64 and sorts first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut, map_batches, texts_of

NULL_ID = -(1 << 63)
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = struct.Struct("<qqIQ")
_SEEK = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


# The normaliser and pre-tokenizer, as a tokenizer's file writes them, whose pieces are known below.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# That pre-tokenizer's pieces of lower-cased text whose characters beyond ASCII are Latin letters below U+0180 (not U+0130,
# which lower-cases to a letter and a mark); fixed by the tokenizer's file. _OTHER finds a text with further characters.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_OTHER = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0")


class Encoder:
    """The tokenizers library; piece by piece and remembered where the tokenizer's file is of a known kind.

    For any other normaliser, pre-tokenizer or post-processor whole texts go to the library. The known
    pre-tokenizer never joins what ASCII white space divides, so the ids of a text are those of its
    words in a row; those of a Latin word are those of its runs of letters, digits and signs. The library
    encodes each new piece, many in one text. A text that spells an added token is encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = lambda part: part and json.loads(part.__getstate__())
        self.by_pieces = told(self.tokenizer.normalizer) == _NORMALIZER and told(self.tokenizer.pre_tokenizer) == _PRE_TOKENIZER and self.tokenizer.post_processor is None and not getattr(self.tokenizer.model, "dropout", None)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new pieces: one text of many, taken apart by its words, or by the places of its tokens where a piece may be several words."""
        size = np.dtype(self.dtype).itemsize
        other = [w for w in new if _OTHER.search(w)]
        for pieces, places in ([w for w in new if not _OTHER.search(w)] if other else new, False), (other, True):
            for begin in range(0, len(pieces), 20_000):
                part = pieces[begin : begin + 20_000]
                got = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
                if places:
                    starts = np.cumsum([0, *(len(w.decode()) + 1 for w in part[:-1])])
                    owner = np.searchsorted(starts, np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0], side="right") - 1
                else:
                    owner = np.array(got.words, dtype=np.int64)
                edges = (np.searchsorted(owner, np.arange(len(part) + 1)) * size).tolist()
                raw = np.array(got.ids, dtype=self.dtype).tobytes()
                self.known.update(zip(part, [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)], strict=True))

    def _pieces(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if text.isascii() and text.isprintable() or not _OTHER.search(raw):
            return _PIECES.findall(raw.lower())
        return [p for w in raw.split() for p in ([w] if _OTHER.search(w) else _PIECES.findall(w.lower()))]

    def _known(self, texts: list[str]) -> Iterator[tuple[list[bytes] | None, str]]:
        """The pieces of each text, all of them learnt (None for a text to be encoded whole), and the text."""
        if not self.by_pieces:
            yield from ((None, text) for text in texts)
            return
        for begin in range(0, len(texts), 1000):
            part = texts[begin : begin + 1000]
            split = [None if any(a in text for a in self.added) else self._pieces(text) for text in part]
            new: set[bytes] = set()
            for pieces in split:
                new.update(set(pieces or ()).difference(self.known))
            if len(self.known) + len(new) > self.most and self.known:
                # Pieces that these texts repeat stay; the others were mostly met once.
                often = {p for p, n in Counter(chain.from_iterable(p for p in split if p)).items() if n > 1}
                self.known = {p: ids for p, ids in self.known.items() if p in often}
                new = {p for pieces in split for p in pieces or () if p not in self.known}
            self._learn(list(new))
            yield from zip(split, part, strict=True)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text (dtype), with the end id."""
        last = np.array([end], dtype=self.dtype).tobytes()
        out = []
        for pieces, text in self._known(texts):
            if pieces is None:
                out.append(np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], dtype=self.dtype).tobytes())
            else:
                out.append(b"".join([*map(self.known.__getitem__, pieces), last]))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has, without an end id."""
        size = np.dtype(self.dtype).itemsize
        return [len(self.tokenizer.encode(text, add_special_tokens=False).ids) if pieces is None else sum(map(len, map(self.known.__getitem__, pieces))) // size for pieces, text in self._known(texts)]


_ENCODERS: dict[str, Encoder] = {}  # of a worker process, kept from task to task


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class FrameWriter:
    """Appends documents to an open file; each frame closes at frame_ids ids or frame_docs documents."""

    def __init__(self, sink, level: int = 3, frame_ids: int = 1 << 17, frame_docs: int = 4096) -> None:
        self.sink, self.frame_ids, self.frame_docs = sink, frame_ids, frame_docs
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.ids: list[int] = []
        self.docs: list[bytes] = []
        self.held = self.n_docs = self.n_ids = 0
        self.seek: list[bytes] = []
        self.index: list[bytes] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.docs.append(ids.astype("<u4").tobytes())
        self.held += len(ids)
        if self.held >= self.frame_ids or len(self.ids) >= self.frame_docs:
            self._flush()

    def _flush(self) -> None:
        if not self.ids:
            return
        sizes = [len(d) // 4 for d in self.docs]
        content = b"".join([struct.pack("<I", len(sizes)), np.array(self.ids, dtype="<i8").tobytes(), np.array(sizes, dtype="<u4").tobytes(), *self.docs])
        frame = self.zstd.compress(content)
        self.sink.write(frame)
        self.seek.append(_SEEK.pack(len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append(_INDEX.pack(self.ids[0], self.ids[-1], len(sizes), sum(sizes)))
        self.n_docs += len(sizes)
        self.n_ids += sum(sizes)
        self.ids, self.docs, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        index, seek = b"".join(self.index), b"".join(self.seek) + _FOOTER.pack(len(self.seek), 0x80, _FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index + struct.pack("<II", _SEEK_MAGIC, len(seek)) + seek)


class FrameReader:
    """Reads the tables at the file's end, then only the frames asked for, each against its checksum."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        frames, descriptor, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != _FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a seekable file")
        at = size - _FOOTER.size - frames * _SEEK.size - 8
        source.seek(at)
        raw = source.read(8 + frames * _SEEK.size)
        if struct.unpack_from("<I", raw)[0] != _SEEK_MAGIC:
            raise ValueError("no seek table")
        self.seek = list(_SEEK.iter_unpack(raw[8:]))
        at -= 8 + frames * _INDEX.size
        source.seek(at)
        raw = source.read(8 + frames * _INDEX.size)
        if struct.unpack_from("<I", raw)[0] != _INDEX_MAGIC:
            raise ValueError("no document index")
        self.index = list(_INDEX.iter_unpack(raw[8:]))
        self.starts = np.concatenate([[0], np.cumsum([s[0] for s in self.seek])]).astype(int).tolist()
        self.first_id = np.concatenate([[0], np.cumsum([i[3] for i in self.index])]).astype(int).tolist()

    def frame(self, k: int) -> Iterator[tuple[int, int, bytes]]:
        """(document id, ids before it in the file, its u32 ids)."""
        packed, size, check = self.seek[k]
        self.source.seek(self.starts[k])
        content = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        n = struct.unpack_from("<I", content)[0]
        ids, sizes = np.frombuffer(content, "<i8", n, 4), np.frombuffer(content, "<u4", n, 4 + 8 * n)
        at, before = 4 + 12 * n, self.first_id[k]
        for doc_id, m in zip(ids.tolist(), sizes.tolist(), strict=True):
            yield doc_id, before, content[at : at + 4 * m]
            at, before = at + 4 * m, before + m


def _layout(docs: DataFrame, file_bytes: int, max_files: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cuts, first, many, files): ids from cuts[i - 1] up to below cuts[i] go to the `many[i]` files from first[i] on.

    Fine cuts by quantiles of doc_id are merged to files of about file_bytes of text. A doc_id that
    spans quantiles has a range of its own, and as many files as its bytes need.
    """
    sized = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = max(file_bytes, -(-total // max_files))
    fine = 8 * -(-total // target)
    if total <= target:
        return np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), 1
    marks = sized.agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 100_000)).first()[0]
    hot = {x for x, y in zip(marks, marks[1:], strict=False) if x == y}
    cuts = np.array(sorted({*marks, *(x + 1 for x in hot)}), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            np.add.at(held, np.searchsorted(shared.value, batch.column(0).to_numpy(), side="right"), batch.column(1).to_numpy())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["range", "size"])

    sizes = np.zeros(len(cuts) + 1, dtype=np.int64)  # 8 * max_files + 1 at most, and as many more of hot ids
    for at, size in sized.mapInArrow(sums, "range int, size long").groupBy("range").agg(F.sum("size")).collect():
        sizes[at] = size
    first, many = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    files = held = 0
    for i, size in enumerate(sizes):
        alone = 0 < i < len(sizes) - 1 and cuts[i] == cuts[i - 1] + 1 and int(cuts[i - 1]) in hot
        if held and (alone or held + size > target):
            files, held = files + 1, 0
        first[i] = files
        held += size
        if alone:
            many[i] = max(1, -(-size // target))
            files, held = files + many[i], 0
    return cuts, first, many, int(files + (1 if held else 0)) or 1


def write_tokens(docs: DataFrame, root: str, tokenizer: str, *, end: int = 1, file_bytes: int = 32 << 20, max_files: int = 20_000) -> DataFrame:
    """Write docs(doc_id, text) under the folder root (a path or URI that all executors share), in ascending doc_id order.

    Returns the manifest, one row for each file: part, path, n_docs, n_ids, start (ids in all files
    before it). Files hold about file_bytes of text whatever the ids are (more only where that would be
    over max_files files); each is written by one task as a stream under a name of its own attempt and
    then moved, so that a task that runs again leaves the same file. Null texts are empty (the end id
    alone); rows that repeat a doc_id stay as often as they occur, over several files where they are
    many; no rows give no files. Other columns are ignored.
    """
    local = docs.sparkSession.sparkContext.master.startswith("local")
    if "://" not in root and not root.startswith(("file:", "/")) and not local:
        raise ValueError(f"not a folder that executors share: {root}")
    cuts, first, many, files = _layout(docs, file_bytes, max_files)
    bounds = docs.sparkSession.sparkContext.broadcast((cuts, first, many))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(tokenizer)
        edges, begin, spread = bounds.value
        keys = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        at = np.searchsorted(edges, keys, side="right")
        ids = coder.encode(texts_of(batch), end)
        part = begin[at]
        for i in np.flatnonzero(spread[at] > 1):
            part[i] += zlib.crc32(ids[i]) % spread[at[i]]
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys), pa.array(ids, type=pa.binary())], names=["part", "doc_id", "ids"])

    coded = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "part int, doc_id long, ids binary")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        fs.create_dir(folder, recursive=True)
        done: list[tuple] = []
        part, writer, sink, temporary = None, None, None, ""

        def close() -> None:
            writer.close()
            sink.close()
            path = f"{folder}/part-{part:06d}.zst"
            fs.move(temporary, path)
            done.append((part, path, writer.n_docs, writer.n_ids))

        for batch in batches:
            for p, doc_id, coded_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if writer is not None:
                        close()
                    part, temporary = p, f"{folder}/_{p:06d}-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temporary)
                    writer = FrameWriter(sink)
                writer.add(doc_id, np.frombuffer(coded_ids, encoder(tokenizer).dtype))
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    dealt = coded.repartitionById(files, "part")
    manifest = cut(dealt.sortWithinPartitions("part", "doc_id", "ids").mapInArrow(write, "part int, path string, n_docs long, n_ids long"))
    # One row for each file, max_files at most.
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def read_tokens(manifest: DataFrame, root: str, wanted: list[int] | None = None, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of the files in a manifest.

    With a list of wanted documents only frames whose range holds one are decompressed.
    """
    asked = None if wanted is None else np.unique(np.array(wanted, dtype=np.int64))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else pafs.LocalFileSystem()
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    for k, (first, last, _, _) in enumerate(reader.index):
                        if asked is not None and np.searchsorted(asked, first) == np.searchsorted(asked, last, side="right"):
                            continue
                        rows = [(None if d == NULL_ID else d, start + before, len(x) // 4, zlib.crc32(x), *([np.frombuffer(x, "<u4").astype(np.int32)] if with_ids else [])) for d, before, x in reader.frame(k) if asked is None or d in asked]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = manifest.select("path", "start")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def new_store(spark: SparkSession) -> str:
    """A new folder of the shared one for a store."""
    from tickwise.llm.common import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
