"""Token ids as flat binary files.

Documents are range-partitioned and sorted by doc_id; each partition writes one file set into the shared folder:
  NAME.bin  the ids, little-endian unsigned integers of the narrowest width that holds the vocabulary (16 bits up to 65,536 ids, else 32)
  NAME.idx  8 bytes magic, 8 bytes number of documents n, then n + 1 unsigned 64-bit offsets in ids from the file's start
  NAME.doc  n signed 64-bit doc_ids, then n bytes that are 1 where the doc_id is null
Names carry a random part, and only the files that a successful task reports are listed in the manifest, so retried or speculative tasks do no harm. A partition's base is the sum of ids in the files before it (prefix sums over one manifest row a partition).

Encoding goes through the tokenizers library. A byte-level BPE that splits at the public pattern always splits before white space that follows a non-space, and between a letter and ASCII punctuation other than an apostrophe, so a text is cut there and each distinct piece is encoded once and remembered in a bounded table. Texts that hold an added token's string are encoded whole.

Cases: null text counts as empty and gives the end id alone; repeated doc_ids are ordered by text; null doc_ids come first; an empty table writes no documents; an empty partition writes empty files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, scratch_path, shuffle_parts, small, vocabulary_path

MAGIC = b"LLTOKID1"
END_ID = 0
CACHE = 1_000_000
VOCABULARY = "byte_bpe_50k.json"
MANIFEST = "part int, name string, n_docs long, n_ids long"
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """ids of texts as packed little-endian integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id; the byte-level alphabet has a character for each byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.plain, self.begins = self._plain(path)

    def _plain(self, path: str):
        """The tokenizer for words that are written in the vocabulary's own characters, each with its space before it: it splits at that space alone, which costs less than the pattern. And which ids begin with it. None for a tokenizer that does anything to a text besides."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or told["truncation"] or told["padding"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            return None, None
        plain = Tokenizer.from_file(path)
        plain.pre_tokenizer = pre_tokenizers.Split(BYTE_CHARS[32], "merged_with_next")
        begins = np.zeros(len(self.width), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            begins[i] = token.startswith(BYTE_CHARS[32])
        return plain, begins

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct words of letters with a space before them."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        written = ["".join(g).encode().decode("latin-1").translate(BYTE_CHARS) for g in groups]
        for group, e in zip(groups, self.plain.encode_batch_fast(written, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            begin = np.flatnonzero(self.begins[ids]) * self.dtype.itemsize
            if len(begin) != len(group):  # a token that spans words
                yield from zip(group, self._whole(group), strict=True)
                continue
            b, at = ids.tobytes(), [*begin.tolist(), None]
            for i, p in enumerate(group):
                yield p, b[at[i] : at[i + 1]]

    def _pieces(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct pieces. Those that begin with white space and end without can stand side by side in one text, as the pattern cuts between them; that saves most calls, and the ids are dealt out by their bytes."""
        if self.plain is not None:
            words = [p for p in new if is_word(p)]
            yield from self._words(words)
            new = [p for p in new if not is_word(p)]
        alone = [p for p in new if not (p[0].isspace() and not p[-1].isspace())]
        yield from zip(alone, self._whole(alone), strict=True)
        side = [p for p in new if p[0].isspace() and not p[-1].isspace()]
        groups = [side[i : i + 256] for i in range(0, len(side), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            upto, ends = np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in group])
            cut = np.searchsorted(upto, ends) + 1
            if not np.array_equal(upto[cut - 1], ends):
                yield from zip(group, self._whole(group), strict=True)
                continue
            b, w, a = ids.tobytes(), self.dtype.itemsize, 0
            for p, c in zip(group, cut.tolist(), strict=True):
                yield p, b[a * w : c * w]
                a = c

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [None if any(s in t for s in self.special) else cuts(t) for t in texts]
        new = list({p for c in cut if c is not None for p in c}.difference(known))
        if len(known) + len(new) > CACHE:  # start anew: what this batch needs, and then what comes
            known.clear()
            new = list({p for c in cut if c is not None for p in c})
        known.update(self._pieces(new))
        get = known.__getitem__
        return [b"".join(map(get, c)) if c is not None else self._whole([t])[0] for t, c in zip(texts, cut, strict=True)]


#: Unicode White_Space, which is what \s is in the public pattern.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space without its last character if a non-space follows; then that character with the non-spaces after it.
pieces: Callable[[str], list[str]] = re.compile(f"[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]?[^{_WS}]+|[{_WS}]+").findall
#: Letters of which Python and the pattern agree, and punctuation that no contraction begins with.
_LATIN, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "!-&(-/:-@\\[-`{-~"
#: The same pieces, with words of such letters cut from punctuation after them: fewer of them are distinct.
cuts: Callable[[str], list[str]] = re.compile(f"[{_WS}]?[{_LATIN}]++(?=[{_WS}{_MARKS}])|[{_WS}]?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+").findall
is_word = re.compile(f" [{_LATIN}]+").fullmatch


def _byte_chars() -> str:
    """The character that byte-level vocabularies have for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


BYTE_CHARS = _byte_chars()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def open_shared(path: str):
    """The file system of a URI and the path in it. Local folders and whatever stores pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _writer(folder: str, path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        fs, root = open_shared(folder)
        fs.create_dir(root, recursive=True)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        lengths, ids = [], []
        with fs.open_output_stream(f"{root}/{name}.bin") as f:
            for b in small(batches):
                for x in enc.encode([t or "" for t in b.column("text").to_pylist()]):
                    f.write(x)
                    f.write(end)
                    lengths.append(len(x) // width + 1)
                ids.append(b.column("doc_id"))
        offsets = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        doc = pa.chunked_array(ids, pa.int64())
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(MAGIC + len(lengths).to_bytes(8, "little") + offsets.tobytes())
        with fs.open_output_stream(f"{root}/{name}.doc") as f:
            f.write(doc.fill_null(0).to_numpy().astype("<i8").tobytes() + doc.is_null().to_numpy().astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns the manifest with each file's base: part, name, n_docs, n_ids, base."""
    spark = docs.sparkSession
    # A set number of partitions: the range bounds alone decide which documents are in a file.
    ordered = id_text(docs).repartitionByRange(shuffle_parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # One row a partition: small however large the corpus is.
    rows = sorted(ordered.mapInArrow(_writer(folder, vocabulary_path(vocabulary), end_id), MANIFEST).collect())
    base, listed = 0, []
    for r in rows:
        listed.append((*r, base))
        base += r.n_ids
    return spark.createDataFrame(listed, MANIFEST + ", base long")


def map_file(folder: str, name: str, kind: str, dtype: np.dtype, skip: int = 0) -> np.ndarray:
    """A file's numbers: memory-mapped where the folder is local, else read."""
    from pyarrow import fs as pafs

    fs, root = open_shared(folder)
    path = f"{root}/{name}.{kind}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", skip) if os.path.getsize(path) > skip else np.zeros(0, dtype)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read()[skip:], dtype)


def read_documents(folder: str, name: str, dtype: np.dtype) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, offset and ids of each document of one file set."""
    ids, offsets = map_file(folder, name, "bin", dtype), map_file(folder, name, "idx", np.dtype("<u8"), 16)
    doc = map_file(folder, name, "doc", np.dtype(np.uint8))
    n = len(offsets) - 1
    doc_id, null = np.frombuffer(bytes(doc[: 8 * n]), "<i8"), doc[8 * n :]
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield (None if null[i] else int(doc_id[i])), a, ids[a:b]


def token_digests(manifest: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    path = vocabulary_path(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = [(d, row["base"] + at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in read_documents(folder, row["name"], encoder(path).dtype)]
                cols = list(zip(*got, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols, strict=True)})

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "token-files")
    return token_digests(write_token_files(docs, folder), folder)
