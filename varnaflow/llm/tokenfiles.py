"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds the documents of one range of ids, in ascending order:

    magic | block, block, ... | doc ids, starts, block offsets | footer (JSON) | its length (8 bytes) | magic

An id takes the fewest bits that the vocabulary needs. A block is BLOCK ids packed from the highest bit on and padded to a
byte, so any id is found by its block's offset and a block is unpacked by numpy at once. Files are written under a temporary
name and renamed, so a task that is run again replaces its file by an equal one; they lie in the shared folder.

Documents are dealt by ``repartitionByRange`` on the id, then a hash of the text, then the row, so many rows of one id are
dealt to many files; the files in order of their range are the whole in order of the ids. Only one row a file (ids and
documents in it) reaches the driver, to add up where each file starts.

Byte-level pieces never cross from one word to the next one led by a blank or a line feed. So a batch of texts is cut into
words at once, each different word is looked up once among those that the task keeps (CACHED_BYTES at most, long words
never) and the library gets only new ones, many in a call; the ids of the texts are gathered from those of the words. A
text with other white space is cut at words led by a single blank only; a text that holds an added token, and every text of
a tokenizer that doesn't cut so, goes to the library whole.

Defined cases: a null text is empty and holds the end id alone; null doc_ids come first; equal doc_ids are ordered by a
hash of the text; an empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_uri, shared_folder

MAGIC, BLOCK = b"VTOKENS1", 65536
#: Words kept by a task: bytes in all (OVERHEAD for the objects of each), and the longest kept. Words a call of the library. Bytes of text encoded at once.
CACHED_BYTES, OVERHEAD, CACHED_CHARS, LINES, BATCH_BYTES = 192 << 20, 180, 64, 1000, 4 << 20
PART = ".part"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each.ravel()).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - bits :] = each
    return np.packbits(whole, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Documents one after the other; ``close`` puts the file in its place."""

    def __init__(self, uri: str, bits: int, attempt: int = 0):
        self.fs, self.path = open_uri(uri)
        self.part, self.bits = f"{self.path}.{attempt}{PART}", bits
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.held, self.waiting = len(MAGIC), 0, []
        self.docs: list[int | None] = []
        self.ends: list[np.ndarray] = []
        self.blocks = [len(MAGIC)]

    def add(self, docs: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of some documents, one behind the other."""
        self.docs += docs
        self.ends.append(lengths)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.empty(0, np.uint16)])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            data = pack(ids[k : min(k + BLOCK, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        ids = np.array([x if x is not None else -(1 << 63) for x in self.docs], "<i8")
        starts = np.concatenate([[0], np.cumsum(np.concatenate([*self.ends, np.empty(0, np.int64)]))]).astype("<u8")
        for x in (ids, starts, np.array(self.blocks, "<u8")):
            self.out.write(x.tobytes())
        footer = json.dumps({"bits": self.bits, "block": BLOCK, "docs": len(ids), "blocks": len(self.blocks), "at": self.at}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(ids), int(starts[-1])


class Reader:
    """Random access to a file: only its footer and the blocks asked for are read."""

    def __init__(self, uri: str):
        fs, path = open_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = int.from_bytes(tail[:8], "little")
        f = json.loads(self.file.read_at(n, size - 16 - n))
        data = self.file.read_at(size - 16 - n - f["at"], f["at"])
        self.bits, self.block = f["bits"], f["block"]
        self.docs = [None if x == -(1 << 63) else int(x) for x in np.frombuffer(data, "<i8", f["docs"])]
        self.starts = np.frombuffer(data, "<u8", f["docs"] + 1, 8 * f["docs"]).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", f["blocks"], 8 * (2 * f["docs"] + 1)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``, counted through the file."""
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, int(self.starts[-1]) - k * self.block)
            parts.append(unpack(self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k])), n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def documents(self, per: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, reading about ``per`` ids at a time."""
        k = 0
        while k < len(self.docs):
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + per, "right")) - 1)
            part, base = self.ids(int(self.starts[k]), int(self.starts[end])), int(self.starts[k])
            for d in range(k, end):
                yield self.docs[d], int(self.starts[d]), part[int(self.starts[d]) - base : int(self.starts[d + 1]) - base]
            k = end


_LED = re.compile(r"(?= \S)")


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``data``, one behind the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)] if len(ends) else data[:0]


def _single(text: str, words: int) -> bool:
    """Whether the text is so many words with one character of white space between any two, and no more white space."""
    found = text.split()
    return len(found) == words and len("".join(found)) + words - 1 == len(text)


class Encoder:
    """Ids of whole texts, as the library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        cut = self.library.pre_tokenizer
        self.by_word = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.library.normalizer is None
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.leads = np.zeros(self.vocabulary, bool)  # ids that begin with a blank or a line feed, as byte-level vocabularies write them
        self.leads[[k for t, k in self.library.get_vocab().items() if t.startswith(("\u0120", "\u010a"))]] = True

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return self.batch([text], 0)[0][:-1]

    def batch(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` behind each text, and how many each has."""
        texts = [t or "" for t in texts]
        words = [t.count(" ") + t.count("\n") + 1 for t in texts]
        whole = [k for k, t in enumerate(texts) if t and (not self.by_word or any(a in t for a in self.added))]
        odd = sorted({*whole, *[k for k, (t, n) in enumerate(zip(texts, words, strict=True)) if t and not _single(t, n)]})
        if not odd:
            return self._joined(texts, words, end_id)
        plain, parts, at = texts.copy(), [], 0
        for k in odd:
            plain[k], words[k] = "", 1
        ids, lengths = self._joined(plain, words, end_id)
        ends, whole = np.cumsum(lengths) - 1, set(whole)
        for k in odd:
            parts += [ids[at : ends[k]], self._library(texts[k]) if k in whole else self._spaced(texts[k])]
            lengths[k], at = len(parts[-1]) + 1, ends[k]
        return np.concatenate([*parts, ids[at:]]), lengths

    def _joined(self, texts: list[str], words: list[int], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts with single blanks and line feeds only. Each is led by a line feed here; the next one's is where the end id goes."""
        one = pa.array([("\n" + "\n".join(texts)).replace("\n", " \n")[1:]], pa.large_string())
        coded = pc.split_pattern(one, " ").flatten().dictionary_encode()
        data, lengths = self._known(coded.dictionary.to_pylist())
        starts, at = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        each = lengths[at]
        ids = np.append(_gathered(data, starts[at], each)[1:], self.kind.type(end_id))
        ends = np.cumsum(np.add.reduceat(each, np.cumsum(words) - words)) - 1
        ids[ends[:-1]] = end_id
        return ids, np.diff(ends, prepend=-1)

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one behind the other, and how many each has. A word stands without the blank before it or with its line feed."""
        data = [*map(self.words.get, words)]
        new = [k for k, x in enumerate(data) if x is None]
        if new:
            names = [words[k] for k in new]
            found = self._new(names, True)
            for k, x in zip(new, found, strict=True):
                data[k] = x
            if max(map(len, names)) > CACHED_CHARS:
                found = [x for x, w in zip(found, names, strict=True) if len(w) <= CACHED_CHARS]
                names = [w for w in names if len(w) <= CACHED_CHARS]
            self.held += sum(map(len, names)) + sum(map(len, found)) + OVERHEAD * len(names)
            if self.held > CACHED_BYTES:
                self.words.clear()
                self.held = 0
            self.words.update(zip(names, found, strict=True))
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // self.kind.itemsize
        return np.frombuffer(b"".join(data), self.kind), lengths

    def _new(self, words: list[str], single: bool = False) -> list[bytes]:
        """The library's ids of words, asked for many in one text: each begins with its blank or line feed, so it is cut there again. single: no other white space in them."""
        out, wide = [b""] * len(words), self.kind.itemsize
        kinds: dict[str, list[int]] = {" ": [], "": [], "odd": []}
        for k, w in enumerate(words):
            feed = w[:1] == "\n"
            kinds["odd" if len(w) == feed or not (single or _single(w[feed:], 1)) else "" if feed else " "].append(k)
        for blank in (" ", ""):
            for a in range(0, len(kinds[blank]), LINES):
                some = kinds[blank][a : a + LINES]
                ids = self._library(blank + blank.join([words[k] for k in some]))
                cuts = (np.flatnonzero(self.leads[ids]) * wide).tolist()
                if len(cuts) != len(some):
                    kinds["odd"] += some
                    continue
                data = ids.tobytes()
                for k, x, y in zip(some, cuts, [*cuts[1:], len(data)], strict=True):
                    out[k] = data[x:y]
        for k in kinds["odd"]:
            out[k] = self._library(words[k] if words[k][:1] == "\n" else " " + words[k]).tobytes()
        return out

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _spaced(self, text: str) -> np.ndarray:
        """A text of other white space too: cut before words led by one blank only."""
        first, *led = _LED.split(text)
        unlike = [*dict.fromkeys(led)]
        coded = dict(zip(unlike, self._new([p[1:] for p in unlike]), strict=True))
        return np.concatenate([self._library(first), np.frombuffer(b"".join([coded[p] for p in led]), self.kind)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[tuple[str, int, int]]:
    """Writes the files; (path, documents, ids) of each, in order of the documents. files: as many as the input has splits, or as shuffles have partitions if that is more."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    files = files or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_t"), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(files, order[0], order[1], F.col("_row")).sortWithinPartitions(*order).select("doc_id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, task, w = encoder(tokenizer), TaskContext.get(), None
        name = f"{folder}/{task.partitionId():06d}.tok"
        for batch in batches:
            w = w or Writer(name, width_of(of.vocabulary), task.taskAttemptId())
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            k = 0
            while k < len(batch):
                end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH_BYTES, "right")))
                some = batch.slice(k, end - k)
                w.add(some.column(0).to_pylist(), *of.batch(some.column(1).to_pylist(), end_id))
                k = end
        if w:
            n, ids = w.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [n], "ids": [ids]})

    found = rows.mapInArrow(written, "file string, docs long, ids long").collect()
    if found:
        from pyarrow.fs import FileSelector

        fs, path = open_uri(folder)
        for left in fs.get_file_info(FileSelector(path)):  # of attempts that were lost
            if left.path.endswith(PART):
                fs.delete_file(left.path)
    return sorted((r["file"], r["docs"], r["ids"]) for r in found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for doc, start, ids in Reader(file).documents():
                rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                if len(rows) == 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    starts = [0, *np.cumsum([n for _, _, n in files]).tolist()] if files else []
    rows = [(f, int(s)) for (f, _, _), s in zip(files, starts, strict=False)]
    listed = spark.createDataFrame(rows, "file string, start long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(spark, write(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_folder(spark)}/tokens"))
