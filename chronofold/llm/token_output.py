"""Token ids as Arrow files of fixed-size-list batches, with masks.

A dataset is a folder of shards. Shard k holds the documents of the k-th range of the
order column; its two files are

``ids-k.arrow``   Arrow IPC file; columns ``ids`` fixed_size_list<uint16>[length] (uint32
                  for vocabularies above 65,536) and ``mask`` fixed_size_list<bool>[length].
                  The shard's ids are laid end to end and cut into equal sequences; only
                  the last one is padded (id 0, mask false). Every batch but the last has ``rows`` sequences, so sequence s
                  is row s % rows of batch s // rows: with a memory map, one sequence is
                  read without parsing or copying anything else.
``docs-k.arrow``  Arrow IPC file; per document its id, its start in the shard's ids, and
                  its number of ids with the end id.

A shard is written under a temporary name and renamed, so a task that is run again
after its executor was lost replaces it by the same bytes.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, parts, released, text_of

#: Distinct words that a worker remembers with their ids, about (some 30 bytes each); beyond it, it starts anew.
REMEMBERED = 1_000_000
#: Characters of the texts whose chunks are encoded together, about (one longer text is encoded by itself).
TOGETHER = 16 << 20
#: Marks that may end a word; a run of them is one piece of its own for a byte-level pre-tokenizer.
MARKS = ".,;:!?%$#&*|)"
_BLANK = "\u0120"  # how byte-level vocabularies write the blank


def gathered(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows flat[offsets[r]:offsets[r + 1]] for each r, laid end to end, and the offsets of the result."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - ends + sizes, sizes)
    return flat[at], np.concatenate([[0], ends])


class ChunkEncoder:
    """Ids of whole texts, without special tokens.

    A byte-level pre-tokenizer breaks before a single blank, so texts without two blanks in
    a row are split at blanks and each distinct chunk of a batch is encoded once: distinct
    chunks are laid end to end and encoded as one text, whose tokens that begin with a
    blank begin the chunks. A word with marks behind it is two such pieces. Words that were
    met before are looked up; what is remembered changes no result.

    Texts with two blanks in a row, with an added token or with a token that has a blank
    inside, and all texts under a tokenizer for which the above does not hold
    (``by_chunks`` is false), are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        added = [t["content"] for t in made.get("added_tokens") or []]
        inner = [self.tokenizer.decode([k], skip_special_tokens=False) for w, k in vocabulary.items() if _BLANK in w.lstrip(_BLANK) and w not in added]
        self.marks = ["  ", *added, *inner]
        simple = all(made.get(k) is None for k in ("normalizer", "truncation", "padding")) and not model.get("dropout")
        self.by_chunks = simple and not any("\ufffd" in w for w in inner) and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        self._forget()
        self.opens = np.zeros(self.size, bool)
        for word, k in vocabulary.items():
            self.opens[k] = word.startswith(_BLANK)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for start in range(0, len(texts), 256):
            found = self.tokenizer.encode_batch_fast(texts[start : start + 256], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in found]
        return out

    def _behind_blanks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of chunks without blanks, none empty, each with a blank before it."""
        flat = []
        for start in range(0, len(chunks), 50_000):
            some = chunks.slice(start, 50_000)
            line = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            flat.append(np.array(self.tokenizer.encode_batch_fast([" " + line], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(chunks):
            raise ValueError("the tokenizer doesn't break at blanks")
        return ids, np.append(starts, len(ids))

    def _remember(self, names: pa.Array) -> np.ndarray:
        """The places of distinct non-empty chunks in ``known``; unknown ones are encoded and added."""
        if len(self.known) > REMEMBERED:
            self._forget()
        unknown = names.filter(pc.is_null(pc.index_in(names, value_set=self.known)))
        ids, offsets = self._behind_blanks(unknown)
        self.known = pa.concat_arrays([self.known, unknown])
        self.known_offsets = np.concatenate([self.known_offsets, self.known_offsets[-1] + offsets[1:]])
        self.known_ids = np.concatenate([self.known_ids, ids])
        return pc.index_in(names, value_set=self.known).to_numpy().astype(np.int64)

    def _forget(self) -> None:
        self.known, self.known_ids, self.known_offsets = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct chunks; a word's ids and those of the marks behind it are looked up apart."""
        base = pc.utf8_rtrim(chunks, MARKS)
        rest = pc.subtract(pc.binary_length(chunks), pc.binary_length(base)).to_numpy().astype(np.int64)
        word = pc.utf8_is_alpha(base).to_numpy(zero_copy_only=False) & (rest < 8)
        first = pc.if_else(pa.array(word), base, chunks).dictionary_encode()
        names = first.dictionary
        empty = pc.index(names, "").as_py()
        place = np.full(len(names), -1, np.int64)
        full = np.arange(len(names)) != empty
        place[full] = self._remember(names.filter(pa.array(full)) if empty >= 0 else names)
        # the marks behind a word, at most seven, as one number
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 : chunks.offset + 1 + len(chunks)]
        data, tail = np.frombuffer(chunks.buffers()[2] or b"", np.uint8), np.zeros(len(chunks), np.uint64)
        for k in range(7):
            has = np.flatnonzero(word & (rest > k))
            tail[has] |= data[ends[has] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        tails, second = np.unique(tail, return_inverse=True)
        marks = [int(t).to_bytes(8, "big").lstrip(b"\0").decode() for t in tails]
        extra = self.whole([" ", *marks])  # an empty chunk is a blank alone
        n = len(self.known)
        flat = np.concatenate([self.known_ids, *extra])
        offsets = np.concatenate([self.known_offsets, self.known_offsets[-1] + np.cumsum([len(x) for x in extra])])
        rows = np.empty(2 * len(chunks), np.int64)
        rows[0::2] = np.where(place < 0, n, place)[first.indices.to_numpy()]
        rows[1::2] = n + 1 + second
        flat, ends_ = gathered(flat, offsets, rows)
        return flat, ends_[::2]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, their ids end to end, offsets), in order, for slices of ``texts`` (strings, no nulls)."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(texts):
            reach = np.cumsum(sizes[start : start + 65_536])
            n = max(1, int(np.searchsorted(reach, TOGETHER, "right")))
            yield from self._together(texts.slice(start, n))
            start += n

    def _together(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        hard = np.full(len(texts), not self.by_chunks)
        for mark in self.marks:
            hard |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        easy = texts.filter(pa.array(~hard)) if hard.any() else texts
        lists = pc.split_pattern(easy, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        chunks = lists.flatten().dictionary_encode()
        flat, offsets = self._distinct(chunks.dictionary)
        rows = chunks.indices.to_numpy().astype(np.int64)
        # no blank stands before a text's first chunk
        opening = pc.take(chunks, pa.array(ends[:-1])).dictionary_decode().dictionary_encode() if len(easy) else chunks
        firsts = self.whole(opening.dictionary.to_pylist()) if len(easy) else []
        if len(easy):
            rows[ends[:-1]] = len(offsets) - 1 + opening.indices.to_numpy()
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in firsts], dtype=np.int64)])
        flat = np.concatenate([flat, *firsts])
        place = np.cumsum(~hard)
        for lo in range(0, len(texts), 512):
            hi = min(lo + 512, len(texts))
            a, b = (place[lo - 1] if lo else 0), place[hi - 1]
            ids, at = gathered(flat, offsets, rows[ends[a] : ends[b]])
            at = at[ends[a : b + 1] - ends[a]]
            if hard[lo:hi].any():
                known, other = iter(np.split(ids, at[1:-1]) if b > a else ()), iter(self.whole([x for x, h in zip(texts.slice(lo, hi - lo).to_pylist(), hard[lo:hi]) if h]))
                parts_ = [next(other if h else known) for h in hard[lo:hi]]
                ids, at = np.concatenate(parts_), np.concatenate([[0], np.cumsum([len(x) for x in parts_])])
            yield hi - lo, ids, at


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text."""
    return [ids[a:b] for _, ids, at in chunk_encoder(path).encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def index_schema(ids: pa.DataType) -> pa.Schema:
    """Schema of the index of documents."""
    return pa.schema([("doc_id", ids), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one shard's two files; memory holds one batch of sequences and the document index."""

    def __init__(self, folder: str, shard: int, length: int, rows: int, pad: int = 0, kind: type = np.uint32):
        self.fs, root = _open(folder)
        self.names = [f"{root}/ids-{shard:06d}.arrow", f"{root}/docs-{shard:06d}.arrow"]
        self.length, self.rows, self.pad, self.kind = length, rows, pad, np.dtype(kind)
        import uuid

        self.temp = f".{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.names[0] + self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0
        self.docs: list[pa.RecordBatch] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose ids (end ids included) lie end to end."""
        starts, sizes = pa.array(self.total + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64())
        self.docs.append(pa.RecordBatch.from_arrays([doc_ids, starts, sizes], schema=index_schema(doc_ids.type)))
        self.total += len(ids)
        self.n_docs += len(doc_ids)
        self.waiting.append(ids.astype(self.kind, copy=False))
        self.held += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        size = self.length * self.rows
        end = len(flat) if last else len(flat) // size * size
        for start in range(0, end, size):
            part = flat[start : min(start + size, end)]
            n = -(-len(part) // self.length)
            ids = np.full(n * self.length, self.pad, self.kind)
            ids[: len(part)] = part
            mask = np.arange(n * self.length) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.waiting = [flat[end:]]
        self.held = len(flat) - end

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        table = pa.Table.from_batches(self.docs, self.docs[0].schema if self.docs else index_schema(pa.int64())).combine_chunks()
        with self.fs.open_output_stream(self.names[1] + self.temp) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table, max_chunksize=65_536)
        for name in self.names:
            self.fs.move(name + self.temp, name)

    def abort(self) -> None:
        """Remove what an interrupted shard has written."""
        self.sink.close()
        for name in self.names:
            if self.fs.get_file_info(name + self.temp).type != pafs.FileType.NotFound:
                self.fs.delete_file(name + self.temp)


class ShardReader:
    """Random access to a shard: sequences by number, documents by their place in the order."""

    def __init__(self, folder: str, shard: int):
        self.fs, root = _open(folder)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        names = [f"{root}/ids-{shard:06d}.arrow", f"{root}/docs-{shard:06d}.arrow"]
        self.files = [pa.memory_map(n) if local else self.fs.open_input_file(n) for n in names]
        self.ids = pa.ipc.open_file(self.files[0])
        self.docs = pa.ipc.open_file(self.files[1])
        self.length = self.ids.schema.field("ids").type.list_size
        self.rows = self.ids.get_batch(0).num_rows if self.ids.num_record_batches else 1
        self._batch: tuple = (-1, np.empty(0), None)

    def _load(self, batch: int) -> tuple[np.ndarray, pa.Array]:
        if self._batch[0] != batch:
            got = self.ids.get_batch(batch)
            self._batch = (batch, got.column(0).values.to_numpy(), got.column(1).values)
        return self._batch[1:]

    def sequence(self, s: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence s: views of the mapped file (the mask is an Arrow array of bits)."""
        ids, mask = self._load(s // self.rows)
        at = s % self.rows * self.length
        return ids[at : at + self.length], mask[at : at + self.length]

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the shard; a view if they lie in one batch."""
        size, out = self.length * self.rows, []
        while n > 0:
            ids, mask = self._load(start // size)
            at = start % size
            got = ids[at : at + n]
            if len(got) == 0 or not mask[at + len(got) - 1].as_py():
                raise ValueError("padding inside a document")
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)

    def documents(self):
        """(doc_id, start, n_tokens) in order."""
        for k in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns))

    def close(self) -> None:
        for f in self.files:
            f.close()


def _writer(folder: str, path: str, end_id: int, length: int, rows: int):
    def run(batches):
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), chunk_encoder(path)
        kind = np.uint16 if max(encoder.size, end_id + 1) <= 65_536 else np.uint32
        out = None
        try:
            for batch in batches:
                start = 0
                for n, ids, at in encoder.encode(batch.column(1)):
                    out = out or ShardWriter(folder, shard, length, rows, kind=kind)
                    out.add(batch.column(0).slice(start, n), np.insert(ids, at[1:], end_id), at + np.arange(n + 1))
                    start += n
            if out:
                out.close()
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [out.n_docs], "n_ids": [out.total]})
        except BaseException:
            if out:
                out.abort()
            raise

    return run


def write_dataset(df: DataFrame, folder: str, tokenizer_path: str, order: list[str], id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 2048, rows: int = 256, shards: int | None = None) -> DataFrame:
    """Encode every whole text, write the shards in ascending ``order``, return the manifest.

    The manifest has one row per shard that has documents: shard, n_docs, n_ids and
    start, the number of ids in all shards before it. Null texts count as empty (their
    document is the end id alone); null ids come first; rows that tie in ``order`` are
    ordered by their text; repeated rows stay; an empty table writes no shard. Ids of any
    type are kept as they are; other columns are ignored.
    """
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    named = [f"order{k}" for k in range(len(order))]
    keys = [F.col(c).asc_nulls_first() for c in named]
    cols = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(order, named)])
    dealt = cols.repartitionByRange(shards or parts(df), *keys).sortWithinPartitions(*keys, "text")
    manifest = cut(dealt.select("id", "text").mapInArrow(released(_writer(folder, tokenizer_path, end_id, length, rows)), "shard int, n_docs long, n_ids long"), "manifest")
    # one row per shard: the offsets are a running sum over as many rows as there are files
    rows_ = sorted((r.shard, r.n_docs, r.n_ids) for r in manifest.collect())
    start, out = 0, []
    for shard, n_docs, n_ids in rows_:
        out.append((shard, n_docs, n_ids, start))
        start += n_ids
    return df.sparkSession.createDataFrame(out, "shard int, n_docs long, n_ids long, start long")


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            for shard, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(folder, shard)
                found: list[tuple] = []
                for doc_id, start, n in reader.documents():
                    crc = zlib.crc32(np.ascontiguousarray(reader.span(start, n), "<u4"))
                    found.append((doc_id, offset + start, n, crc, shard, start // reader.length, start % reader.length))
                    if len(found) == 20_000:
                        yield _doc_rows(found, reader.docs.schema.field(0).type)
                        found = []
                if found:
                    yield _doc_rows(found, reader.docs.schema.field(0).type)
                reader.close()

    return run


READ = "start long, n_tokens long, ids_crc32 long, shard int, sequence long, sequence_at long"


def _doc_rows(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    kinds = [ids] + [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
    names = ["doc_id", *(x.split()[0] for x in READ.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)


def read_documents(manifest: DataFrame, folder: str, ids: str = "long") -> DataFrame:
    """Per document, from the files: its id (of the Spark type ``ids``), start over all shards, number and checksum of its ids, and where it begins."""
    todo = manifest.select("shard", "start").repartition(max(1, manifest.count()), "shard")
    return todo.mapInArrow(released(_reader(folder)), f"doc_id {ids}, {READ}")


def token_documents(df: DataFrame, tokenizer_path: str, order: list[str] | None = None, folder: str | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """Write the dataset to ``folder`` (a fresh shared one if none is given) and return what reading it back gives."""
    folder = folder or fresh_path(df.sparkSession, "tokens")
    return read_documents(write_dataset(df, folder, tokenizer_path, order or [id_col], id_col, **how), folder, df.schema[id_col].dataType.simpleString())
