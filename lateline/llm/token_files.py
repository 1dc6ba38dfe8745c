"""Token ids as Arrow files of equal-length sequences with masks.

Documents are dealt by ranges of doc_id, tokenised in order and written as one file per range: the
Arrow IPC file form of the stream format, whose footer names every batch. A batch holds ``ROWS``
sequences (the last of a file fewer) in four columns: fixed-size lists of ``LENGTH`` values ``ids``
(unsigned, as wide as the vocabulary needs), ``mask`` (true on ids, false on padding) and ``last``
(true on the last id of a document), and ``doc``, the document of the file that the sequence starts
in. Fixed sizes make sequence i row ``i % ROWS`` of batch ``i // ROWS``, and its ids and its masks
(bits, least significant first) slices of the mapped file, without copying. Documents follow each
other without gaps, an end id after each. A second Arrow file beside it lists the documents: doc_id,
start, n_tokens.

Files are written with ``pyarrow.fs`` below a folder every executor reaches (any scheme that it
opens: file, hdfs, s3, gs). Every attempt of a task writes names of its own and only the rows of the
successful attempt reach the manifest, so lost executors and repeated tasks leave unnamed files at
most, never a wrong one.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lateline.session import materialize, new_path

LENGTH, ROWS = 2048, 64
#: Pieces of text and ids a worker remembers, and the longest piece it does.
KEPT_PIECES, KEPT_IDS, KEPT_LENGTH = 1_000_000, 8_000_000, 64
#: Documents are encoded in groups of about so many characters.
GROUP = 1 << 20

MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def load_tokenizer(path: str) -> str:
    """The definition of a tokenizer of the tokenizers library, to be sent to the tasks."""
    return Path(path).read_text(encoding="utf-8")


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece of text encoded once.

    A byte-level tokenizer that adds no blank always starts a new token at a single blank between two
    characters that are not white space. Texts are cut there, and only pieces not seen before go
    through the library, many in one call: laid end to end, each starts at the one token that begins
    with its blank. Of any other tokenizer whole texts go through it. Strings of special tokens
    are ordinary text.
    """

    CUT = re.compile(r"(?<=\S)(?= \S)")
    #: White space other than blank and line break: a text with it is cut by rule, like one with a
    #: blank beside white space; all others simply at their blanks.
    RARE = "".join(filter(re.compile(r"[^\S \n]").match, map(chr, range(0x3001))))
    TOGETHER = 20_000

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(definition)
        words = rules.get("pre_tokenizer") or {}
        self.by_piece = (rules.get("normalizer") is None and words.get("type") == "ByteLevel"
                         and not words.get("add_prefix_space", True) and words.get("use_regex", True)
                         and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"])
                                     for t in rules.get("added_tokens", [])))
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[n for token, n in vocabulary.items() if token.startswith("Ġ")]] = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        #: Numbers of texts as they are, and of texts after a blank; ids and uses by number.
        self.plain: dict[str, int] = {}
        self.after_blank: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.sizes, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.count = 0
        #: Long pieces of the texts at hand, to be forgotten after them.
        self.long: list[tuple[dict, str]] = []

    def _trim(self) -> None:
        """Keep what was used more than once; forget all if that is still much."""
        kept = np.flatnonzero(self.uses[:self.count] > 1)
        if len(kept) > KEPT_PIECES // 2:
            self._forget()
            return
        number = np.full(self.count, -1, np.int64)
        number[kept] = np.arange(len(kept))
        numbers = number.tolist()
        self.plain, self.after_blank = ({k: numbers[n] for k, n in known.items() if numbers[n] >= 0}
                                        for known in (self.plain, self.after_blank))
        self.pool = self._ids(kept)
        self.used, self.count = len(self.pool), len(kept)
        self.sizes = self.sizes[kept]
        self.starts, self.uses = np.cumsum(self.sizes) - self.sizes, np.ones(len(kept), np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, end to end."""
        sizes = self.sizes[numbers]
        shift = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.starts[numbers] - shift, sizes) + np.arange(int(sizes.sum()))]

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add pieces, given by their ids end to end; returns the number of the first."""
        first, n = self.count, len(sizes)
        self.starts, self.sizes, self.uses = (
            self._room(x, first + n) for x in (self.starts, self.sizes, self.uses))
        self.pool = self._room(self.pool, self.used + len(ids))
        self.pool[self.used:self.used + len(ids)] = ids
        self.sizes[first:first + n] = sizes
        self.starts[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.uses[first:first + n] = 0
        self.used, self.count = self.used + len(ids), first + n
        return first

    def _learn(self, pieces: list[str]) -> range:
        """Encode new pieces; returns their numbers."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))
        first = self._store(ids, sizes)
        return range(first, first + len(pieces))

    def _learn_spaced(self, pieces: list[str]) -> range:
        """The same for pieces that follow a blank and hold none."""
        n = len(pieces)
        joined = ["".join([f" {p}" for p in pieces[k:k + self.TOGETHER]]) for k in range(0, n, self.TOGETHER)]
        found = [np.array(e.ids, self.dtype)
                 for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, self.dtype)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != n or n and starts[0]:
            return self._learn([f" {p}" for p in pieces])
        first = self._store(ids, np.diff(np.append(starts, len(ids))))
        return range(first, first + n)

    def _even(self, text: str) -> bool:
        return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in self.RARE))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a long text is taken in parts of about ``GROUP`` characters."""
        if not self.by_piece:
            return self._whole(texts)
        if all(len(t) <= 2 * GROUP for t in texts):
            return self._encode(texts)
        out = []
        for text in texts:
            parts, at = [], 0
            while at < len(text):
                cut = self.CUT.search(text, at + GROUP)
                end = cut.start() if cut else len(text)
                parts += self._encode([text[at:end]])
                at = end
            out.append(np.concatenate(parts) if parts else np.empty(0, self.dtype))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.count > KEPT_PIECES or self.used > KEPT_IDS:
            self._trim()
        # Even texts: what precedes the first blank, then pieces after one blank each.
        firsts, spaced, counts, odd = [], [], [], []
        for text in texts:
            if self._even(text):
                head, blank, rest = text.partition(" ")
                firsts.append(head)
                pieces = rest.split(" ") if blank else ()
                spaced.extend(pieces)
                counts.append((1, len(pieces), False))
            else:
                pieces = self.CUT.split(text)
                odd.extend(pieces)
                counts.append((len(pieces), 0, True))
        found = [self._numbers(self.plain, firsts, self._learn),
                 self._numbers(self.after_blank, spaced, self._learn_spaced),
                 self._numbers(self.plain, odd, self._learn)]
        # In the order of the texts: the first piece, then the others, or the pieces cut by rule.
        at, parts = [0, 0, 0], []
        for first, later, by_rule in counts:
            for k, n in ((2, first),) if by_rule else ((0, first), (1, later)):
                parts.append(found[k][at[k]:at[k] + n])
                at[k] += n
        numbers = np.concatenate(parts)
        self.uses[:self.count] += np.bincount(numbers, minlength=self.count)
        ids = self._ids(numbers)
        for known, piece in self.long:
            known.pop(piece, None)
        self.long = []
        ends = np.cumsum([first + later for first, later, _ in counts])
        return np.split(ids, np.cumsum(self.sizes[numbers])[ends[:-1] - 1])

    def _numbers(self, known: dict[str, int], pieces: list[str], learn) -> np.ndarray:
        """The numbers of pieces; those not known yet are learnt."""
        out = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            fresh = list({pieces[k] for k in missing})
            known.update(zip(fresh, learn(fresh)))
            self.long += [(known, p) for p in fresh if len(p) > KEPT_LENGTH]
            out[missing] = [known[pieces[k]] for k in missing]
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """This process's encoder; what it has learnt serves the next task of the same worker too."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _filesystem(uri: str):
    """The file system of a folder's URI (a plain path is a local or mounted folder) and its path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def schemas(dtype: np.dtype, length: int) -> pa.Schema:
    bits = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", bits),
                      ("last", bits), ("doc", pa.int64())])


class Writer:
    """Writes one shard: documents in order, cut into equal sequences, batches of equal size."""

    def __init__(self, folder: str, dtype, id_type: pa.DataType, length: int = LENGTH, rows: int = ROWS):
        if length % 8:
            raise ValueError("the length of a sequence is a multiple of 8")
        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}"
        self.length, self.rows, self.schema = length, rows, schemas(dtype, length)
        self.sink = fs.open_output_stream(f"{at}/{self.name}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.listed = fs.open_output_stream(f"{at}/{self.name}.docs.arrow")
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs_file = pa.ipc.new_file(self.listed, self.docs_schema)
        self.ids = np.empty(0, dtype)
        self.n_docs = self.n_tokens = self.written = 0
        #: Ends of documents that reach beyond what is written.
        self.ends = np.empty(0, np.int64)

    def add(self, doc_ids: pa.Array, encoded: list[np.ndarray], end_id: int) -> None:
        sizes = np.array([len(e) + 1 for e in encoded], np.int64)
        ends = self.n_tokens + np.cumsum(sizes)
        end = np.array([end_id], self.ids.dtype)
        self.docs_file.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(ends - sizes), pa.array(sizes)], schema=self.docs_schema))
        self.ids = np.concatenate([self.ids, *(x for e in encoded for x in (e, end))])
        self.ends = np.concatenate([self.ends, ends])
        self.n_docs, self.n_tokens = self.n_docs + len(sizes), int(ends[-1])
        step = self.length * self.rows
        rest = len(self.ids) // step * step
        for at in range(0, rest, step):
            self._write(self.ids[at:at + step])
        self.ids = self.ids[rest:].copy()

    def _write(self, ids: np.ndarray) -> None:
        """One batch; the last of a file is padded to whole sequences."""
        n = len(ids)
        ids = np.pad(ids, (0, -n % self.length))
        done = int(np.searchsorted(self.ends, self.written + n, "right"))
        last = np.zeros(len(ids), bool)
        last[self.ends[:done] - 1 - self.written] = True
        first = self.written + np.arange(0, n, self.length)
        doc = self.n_docs - len(self.ends) + np.searchsorted(self.ends, first, "right")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
                 for x in (ids, np.arange(len(ids)) < n, last)]
        self.file.write_batch(pa.RecordBatch.from_arrays([*lists, pa.array(doc)], schema=self.schema))
        self.written += n
        self.ends = self.ends[done:]

    def close(self) -> tuple[str, int, int]:
        if len(self.ids):
            self._write(self.ids)
        for file, sink in ((self.file, self.sink), (self.docs_file, self.listed)):
            file.close()
            sink.close()
        return self.name, self.n_docs, self.n_tokens


class Shard:
    """Random access to a written shard; on a local or mounted folder without copying."""

    def __init__(self, folder: str, name: str):
        fs, at = _filesystem(folder)
        from pyarrow import fs as filesystems

        local = isinstance(fs, filesystems.LocalFileSystem)
        opened = lambda p: pa.memory_map(p) if local else fs.open_input_file(p)
        self.file = pa.ipc.open_file(opened(f"{at}/{name}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{at}/{name}.docs.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    @property
    def n_sequences(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def _ids(self, k: int) -> np.ndarray:
        return self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)

    def _bits(self, k: int, column: str) -> np.ndarray:
        values = self.file.get_batch(k).column(column).flatten()
        return np.frombuffer(values.buffers()[1], np.uint8, len(values) // 8, values.offset // 8)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, mask bits and last bits of sequence ``i``: views of the file's bytes."""
        k, row = divmod(i, self.rows)
        ids = self._ids(k)[row * self.length:(row + 1) * self.length]
        bits = slice(row * self.length // 8, (row + 1) * self.length // 8)
        return ids, self._bits(k, "mask")[bits], self._bits(k, "last")[bits]

    def first_document(self, i: int) -> int:
        """The document of the shard in which sequence ``i`` starts."""
        k, row = divmod(i, self.rows)
        return self.file.get_batch(k).column("doc")[row].as_py()

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the shard."""
        step = self.length * self.rows
        parts = [self._ids(k)[max(start - k * step, 0):start + n - k * step]
                 for k in range(start // step, (start + n - 1) // step + 1)] if n else []
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint16), *parts])

    def documents(self) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
        """The lists of documents, each with the ids of its documents, whose bounds the masks give.

        One batch of sequences and one document are held at a time.
        """
        ids = self._documents()
        for k in range(self.docs.num_record_batches):
            batch = self.docs.get_batch(k)
            yield batch, (next(ids) for _ in range(batch.num_rows))

    def _documents(self) -> Iterator[np.ndarray]:
        open_: list[np.ndarray] = []
        for k in range(self.file.num_record_batches):
            ids, at = self._ids(k), 0
            last = np.unpackbits(self._bits(k, "last"), bitorder="little")
            for end in (np.flatnonzero(last) + 1).tolist():
                yield np.concatenate([*open_, ids[at:end]]) if open_ else ids[at:end]
                open_, at = [], end
            mask = np.unpackbits(self._bits(k, "mask"), bitorder="little")
            rest = ids[at:][mask[at:] != 0]
            if len(rest):
                open_.append(rest)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Documents in groups of about ``GROUP`` characters, an Arrow batch at most."""
    for batch in batches:
        ids, texts, at, size = batch.column("doc_id"), [], 0, 0
        for k, text in enumerate(batch.column("text")):
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= GROUP:
                yield ids.slice(at, len(texts)), texts
                texts, at, size = [], k + 1, 0
        if texts:
            yield ids.slice(at, len(texts)), texts


def write_tokens(docs: DataFrame, definition: str, end_id: int, folder: str | None = None,
                 length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write the ids of all whole texts in ascending doc_id order; returns the manifest.

    One row per file: shard (order of the files), path (folder and name), n_docs, n_tokens. A null
    text is an empty one and has its end id only; a null doc_id comes first; rows that repeat a
    doc_id are documents of their own, ordered by a hash of their text; an empty table has no files;
    further columns are ignored. ``folder`` must be one that all executors reach; without it a
    new one in the session's shared folder is taken.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    if end_id < 0:
        raise ValueError(end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        writer = None
        for doc_ids, texts in _groups(batches):
            if writer is None:
                encoder = encoder_of(definition)
                dtype = encoder.dtype if end_id <= np.iinfo(encoder.dtype).max else np.uint32
                writer = Writer(folder, dtype, doc_ids.type, length, rows)
            writer.add(doc_ids, encoder.encode(texts), end_id)
        if writer is not None:
            name, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"],
                 "n_docs": [n_docs], "n_tokens": [n_tokens]})

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns(
        {"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    ranged = (keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    return materialize(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all shards before.

    Two levels, so that no task sees all files: sums of 1,024 shards at a time, then inside these.
    """
    blocks = manifest.withColumn("block", F.floor(F.col("shard") / 1024))
    totals = blocks.groupBy("block").agg(F.sum("n_tokens").alias("n_block"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("block", F.coalesce(F.sum("n_block").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.join(before, "block")
            .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
            .select(*manifest.columns, "start"))


def read_documents(manifest: DataFrame, id_type: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of every document, one task per file.

    ``start`` counts the ids of all documents before, over all files. The checksum is that of the
    ids as little-endian unsigned 32-bit integers. A document whose listed start or size differs
    from what the masks of the sequences give raises an error.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                at = 0
                for listed, encoded in Shard(*path.rsplit("/", 1)).documents():
                    starts, sizes, sums = [], [], []
                    for ids in encoded:
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at += len(ids)
                    if (starts != listed.column("start").to_pylist()
                            or sizes != listed.column("n_tokens").to_pylist()):
                        raise ValueError(f"list and sequences differ: {path}")
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": listed.column("doc_id"),
                         "start": pa.array([base + s for s in starts], pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    files = shard_starts(manifest).select("shard", "path", "start")
    dealt = files.repartitionByRange(max(1, manifest.count()), "shard")
    return dealt.mapInArrow(
        read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, definition: str, end_id: int) -> DataFrame:
    """Write all texts' ids to files and return what the files say of every document."""
    manifest = write_tokens(docs, definition, end_id)
    return read_documents(manifest, docs.schema["doc_id"].dataType.simpleString())
