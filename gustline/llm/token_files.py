"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out in ranges of ``doc_id``; each task encodes its documents in order and writes one
Arrow file. The ids of a file are one stream, cut into sequences of ``length`` ids: batches of
fixed-size lists of ids and of mask bits (false on the padding behind the last document). All batches but the last
hold the same number of sequences, so sequence k is row k % rows of batch k // rows, read from
a memory map without a copy. A table beside the files says where each document lies.

A file is written under a name of its attempt and then renamed; a repeated task writes the same bytes.

Defined results: a null text is encoded as an empty one, which leaves the end id alone; a null ``doc_id`` comes
first; rows that share a ``doc_id`` follow each other in the order of their texts; an empty table gives no files and an
empty result; strings that are special tokens of the vocabulary become their ids, as the library's own call has it (``plain_specials``
of the encoder makes them ordinary text); other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gustline.session import materialise, shared_dir

LENGTH = 1024
BATCH_SEQUENCES = 256
#: Pieces whose ids a worker remembers, twice; bounds memory only.
REMEMBERED = 450_000
INDEX = "part int, doc_id long, position long, n_tokens long"


#: Texts are encoded together up to this many bytes, a longer one alone.
SLICE_BYTES = 4 << 20
#: Kinds of characters: letters (and the space before a part), marks, line ends, all others. An apostrophe is no mark:
#: contractions are pieces. Letters beyond the Latin, Greek and Cyrillic blocks count as others.
LETTER, MARK, LINE, OTHER = range(4)
KINDS = np.array([LETTER if chr(c).isalpha() else OTHER for c in range(0x530)] + [OTHER], np.uint8)
KINDS[ord(" ")] = LETTER
KINDS[[ord(c) for c in punctuation if c != "'"]] = MARK
KINDS[ord("\n")] = LINE
_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder_of(tokenizer_json: str, dtype: str) -> Encoder:
    """One encoder per worker process, so tasks share what it remembers."""
    key = (hash(tokenizer_json), dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json, dtype)
    return _ENCODERS[key]


def gathered(pool: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of a pool (run after run, of these sizes) that ``which`` names, one behind the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[which] - (ends - n)
    return pool[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]


def _kinds(text: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
    return KINDS[np.minimum(points, len(KINDS) - 1)][np.cumsum(text & 0xC0 != 0x80) - 1]


class Encoder:
    """Ids of whole texts, remembering the ids of pieces.

    The pre-tokenizer never joins a piece over a single space between two other characters, so
    encoding the parts (each with its space) gives the ids of the whole. Letters, marks behind them and a
    line end between words are pieces of their own, so most parts are put together from pieces
    that other parts share. Texts with other white space beside a space, or with a special
    token, are encoded whole. A batch is split into parts and pieces in Arrow; Python sees
    each distinct piece once.
    """

    def __init__(self, tokenizer_json: str, dtype: str, plain_specials: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(dtype)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters, each behind a space and so a piece of its own, from few long texts."""
        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            found = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids, word = np.asarray(found.ids, self.dtype).tobytes(), np.asarray(found.word_ids, np.int32)
            size = self.dtype.itemsize
            cuts = [0, *((np.flatnonzero(np.diff(word)) + 1) * size).tolist(), len(ids)]
            if len(cuts) != len(some) + 1:      # letters here that are none to the tokenizer
                yield from self._encode(some)
                continue
            yield from [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, new: list[str]) -> None:
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        self.known.update(zip(words, self._encode_words(words), strict=True))
        others = [p for p in new if p not in self.known]
        self.known.update(zip(others, self._encode(others), strict=True))

    def _pool(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one behind the other, and how many each has."""
        if len(self.known) > REMEMBERED:        # what is met again comes back from the generation before
            self.before, self.known = self.known, {"": b""}
        new = [p for p in pieces if p not in self.known]
        self.known.update((p, self.before[p]) for p in new if p in self.before)
        self._learn([p for p in new if p not in self.before])
        return self._joined([self.known[p] for p in pieces])

    def _joined(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // self.dtype.itemsize
        return np.frombuffer(b"".join(runs), self.dtype), sizes

    def _parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct parts behind a space. Parts of plain letters, marks and single line ends are cut
        where the kind of character changes; others are one piece."""
        spaced = pc.binary_join_element_wise(" ", parts, "")
        _, offsets, data = spaced.buffers()
        offsets = np.frombuffer(offsets, np.int32)[spaced.offset:spaced.offset + len(parts) + 1]
        first, lengths = offsets[:-1], np.diff(offsets)
        kind = _kinds(np.frombuffer(data, np.uint8)[:offsets[-1]])
        cut = np.concatenate([[True], kind[1:] != kind[:-1]])
        whole = np.logical_or.reduceat((kind == OTHER) | ((kind == LINE) & ~cut), first)
        whole |= kind[first + (lengths > 1)] != LETTER
        cut &= ~np.repeat(whole, lengths)
        cut[first] = True
        at = np.append(np.flatnonzero(cut), offsets[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        pool, sizes = self._pool(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        return gathered(pool, sizes, which), np.add.reduceat(sizes[which], np.searchsorted(at, first))

    def __call__(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, each with ``end``, and how many each has."""
        split = pc.split_pattern(texts, " ")
        n, starts = len(texts), split.offsets.to_numpy().astype(np.int64)
        starts = starts[:n + 1] - starts[0]
        parts = split.flatten().dictionary_encode()
        odd = pc.or_(pc.equal(parts.dictionary, ""),
                     pc.not_equal(pc.utf8_trim_whitespace(parts.dictionary), parts.dictionary)).to_numpy(zero_copy_only=False)
        which = parts.indices.to_numpy().astype(np.int64)
        whole = np.logical_or.reduceat(odd[which], starts[:-1])
        for special in self.specials:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        pool, sizes = self._parts(pc.if_else(pa.array(odd), "", parts.dictionary))
        # the first part has no space before it; behind a text encoded whole, and for its other parts, there is nothing
        first = pc.if_else(pa.array(whole), texts, split.flatten().take(pa.array(starts[:-1])))
        heads, head_sizes = self._joined(self._encode(first.to_pylist()))
        ends = np.frombuffer(end, self.dtype)
        n_parts, n_docs = len(sizes), np.diff(starts)
        nothing, the_end = n_parts + n, n_parts + n + 1
        which[np.repeat(whole, n_docs)] = nothing
        which[starts[:-1]] = n_parts + np.arange(n)
        which = np.insert(which, starts[1:], the_end)
        sizes = np.concatenate([sizes, head_sizes, [0, len(ends)]])
        ids = gathered(np.concatenate([pool, heads, ends]), sizes, which)
        return ids, np.add.reduceat(sizes[which], starts[:-1] + np.arange(n))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes; a longer text stands alone."""
    sizes = pc.binary_length(texts).to_pylist()
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if sizes:
        yield at, len(sizes)


def _file_system(folder: str):
    from pyarrow import fs
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    if folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    return fs.LocalFileSystem(), folder


def part_path(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.arrow"


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, folder: str, part: int, attempt: str, dtype: str, length: int) -> None:
        self.fs, folder = _file_system(folder)
        self.fs.create_dir(folder, recursive=True)
        self.final, self.temporary = part_path(folder, part), f"{part_path(folder, part)}.{attempt}"
        self.dtype, self.length = np.dtype(dtype), length
        kinds = [("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(kinds, metadata={"length": str(length), "batch_sequences": str(BATCH_SEQUENCES)})
        self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.n_waiting, self.position = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.position += len(ids)
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, self.dtype), *self.waiting])
        step = self.length * BATCH_SEQUENCES
        end = len(ids) if last else len(ids) // step * step
        for at in range(0, end, step):
            some = ids[at:min(at + step, end)]
            padded = -(-len(some) // self.length) * self.length
            values = np.zeros(padded, self.dtype)
            values[:len(some)] = some
            self.writer.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(np.arange(padded) < len(some)), self.length)],
                schema=self.schema))
        self.waiting, self.n_waiting = [ids[end:].copy()], len(ids) - end

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.temporary, self.final)


class SequenceReader:
    """Random access to the ids of one file."""

    def __init__(self, folder: str, part: int) -> None:
        self.fs, folder = _file_system(folder)
        path = part_path(folder, part)
        local = self.fs.type_name == "local"
        self.source = pa.memory_map(path) if local else self.fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.rows = int(self.file.schema.metadata[b"batch_sequences"])
        self.at, self.batch = -1, None

    def _values(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k).column("ids").flatten().to_numpy()
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask; the ids are a view of the file."""
        batch = self.file.get_batch(k // self.rows)
        return (batch.column("ids")[k % self.rows].values.to_numpy(),
                batch.column("mask")[k % self.rows].values.to_numpy(zero_copy_only=False))

    def ids(self, position: int, n: int) -> np.ndarray:
        step, out = self.length * self.rows, []
        while n > 0:
            values = self._values(position // step)[position % step:position % step + n]
            out.append(values)
            position, n = position + len(values), n - len(values)
        return np.concatenate(out) if len(out) > 1 else out[0]

    def close(self) -> None:
        self.batch = self.file = None
        self.source.close()


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    index: DataFrame        # part, doc_id, position (in the file), n_tokens, start (in the whole)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH) -> TokenFiles:
    """Encode all documents, in ascending order of ``doc_id``, into files below the shared folder."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    tokenizer_json = Path(tokenizer_path).read_text()
    from tokenizers import Tokenizer
    dtype = "<u2" if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 else "<u4"
    end = np.asarray([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = writer = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at, to in slices(batch.column("text")):
                some = batch.slice(at, to - at)
                if writer is None:
                    encode = encoder_of(tokenizer_json, dtype)
                    writer = SequenceWriter(folder, part, str(TaskContext.get().taskAttemptId()), dtype, length)
                ids, sizes = encode(some.column("text"), end)
                places = writer.position + np.cumsum(sizes) - sizes
                writer.add(ids)
                yield pa.record_batch([pa.array([part] * len(sizes), pa.int32()), some.column("doc_id"),
                                       pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                                      names=["part", "doc_id", "position", "n_tokens"])
        if writer is not None:
            writer.close()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    index = materialise(ordered.mapInArrow(write, INDEX), "token-index")
    # one row per file
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"))
    index = index.join(F.broadcast(totals), "part").withColumn("start", F.col("ids_before") + F.col("position"))
    return TokenFiles(folder, index.drop("ids_before"))


def read_documents(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of every document, from the files.

    The index is stored file by file, so its rows come in the order of the ids.
    """
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = reader = None
        for batch in batches:
            sums = []
            for p, position, n in zip(*(batch.column(c).to_pylist() for c in ("part", "position", "n_tokens")),
                                      strict=True):
                if p != part:
                    if reader is not None:
                        reader.close()
                    part, reader = p, SequenceReader(folder, p)
                sums.append(zlib.crc32(reader.ids(position, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
                                   pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.index.select("part", "position", "doc_id", "start", "n_tokens")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_documents(write_token_files(docs, tokenizer_path))
