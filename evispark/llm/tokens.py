"""Token ids of texts by a public tokenizer file, and files of them in independent zstandard frames.

A token file holds one frame for each document, one frame with the document ids, and a trailing seek table with the sizes
of all frames and a checksum of each, in the seekable zstandard format. A reader decompresses the ids' frame and those of
the documents it is asked for.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shared_path
from .common import bucket_count, bucket_of, part_of, quantile_cuts

END_ID = 1
#: Fixed values of the seekable zstandard format: skippable frame, seek table, and "checksums are there".
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts as the tokenizer file says, without special tokens, and remembers the ids of words.

    The file's rules never look across ASCII white space, and drop it, so a text's ids are those of its words in a row.
    Words of plain Latin letters go to the file's merges by piece; all others go through the whole tokenizer.
    """

    #: Words that a half of the memory holds at most. When it is full it becomes the old half, and what was old and wasn't met
    #: since is forgotten, so frequent words stay. Pieces of words are remembered as words.
    MOST = 200_000
    PLAIN = re.compile("[\x21-\x7e\xa1-įı-ſ]+")
    MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces = regex.compile(self.PIECES)
        self.plain_rules = self._has_known_rules(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.by_word: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}

    def _has_known_rules(self, path: str) -> bool:
        """Whether the file lower-cases, cuts by PIECES and maps bytes, so that the short way is right."""
        import json

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers") or []]
        return cut[0].get("pattern", {}).get("Regex") == self.PIECES and norm == ["NFC", "Replace", "Lowercase"]

    def _merged(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _encode(self, word: bytes) -> bytes:
        if self.plain_rules:
            # ASCII letters are one piece, with a mark after them two.
            if word.isalpha():
                low = word.lower()
                return self._merged(low.decode()) if low == word else self._word(low)
            if word[-1:] in self.MARKS and word[:-1].isalpha():
                return self._word(word[:-1].lower()) + self._word(word[-1:])
        text = word.decode("utf-8", "replace")
        if not self.plain_rules or "<|" in text or not self.PLAIN.fullmatch(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        low = text.lower()
        pieces = [low] if low.isalpha() else self.pieces.findall(low)
        if len(pieces) == 1 and pieces[0] == text:
            return self._merged(text)
        return b"".join([self._word(p.encode()) for p in pieces])

    def _word(self, word: bytes) -> bytes:
        """The ids of a word, which goes to the new half of the memory."""
        ids = self.by_word.get(word)
        if ids is not None:
            return ids
        ids = self.old_words.get(word) or self._encode(word)
        if len(word) <= 64:
            if len(self.by_word) >= self.MOST:
                self.old_words, self.by_word = self.by_word, {}
            self.by_word[word] = ids
        return ids

    def _words(self, words: list[bytes]) -> list[bytes]:
        """``_word`` of distinct words, some of them empty; lower-case ASCII ones that are new go straight to the merges."""
        out = list(map(self.by_word.get, words))
        old, tokenize, plain = self.old_words.get, self.model.tokenize, self.plain_rules
        new = {}
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                ids = old(word)
                if ids is None:
                    if plain and word.isalpha() and word.islower():
                        ids = array("I", [t.id for t in tokenize(word.decode())]).tobytes()
                    else:
                        ids = self._encode(word) if word else b""
                if len(word) <= 64:
                    new[word] = ids
                out[i] = ids
        if len(self.by_word) + len(new) > self.MOST:
            self.old_words, self.by_word = self.by_word, {}
        self.by_word.update(new)
        return out

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 32-bit integers."""
        words = text.split()
        out = list(map(self.by_word.get, words))
        if None in out:
            out = [self._word(word) if ids is None else ids for word, ids in zip(words, out, strict=True)]
        return b"".join(out)


    #: Bytes of text that ``many`` looks at in one go.
    BLOCK = 8 << 20

    def many(self, column: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text of a string column, null as empty; words are told apart once for each block of texts."""
        sizes = column.cast(pa.binary()).fill_null(b"")
        ends = np.cumsum(pc.binary_length(sizes).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, done + self.BLOCK, side="right")))
            if ends[end - 1] - done > self.BLOCK:
                yield self.ids(sizes[at].as_py())
            else:
                yield from self._block(column.slice(at, end - at).fill_null(""))
            at, done = end, int(ends[end - 1])

    def _block(self, column: pa.Array) -> list[bytes]:
        """Each distinct word is a stem, lower-cased where the file does so too, and a mark or nothing; each distinct stem is encoded.

        A block has fewer than 2^31 ids, so places are 32-bit numbers; what is done with goes before the ids are laid out.
        """
        words = pc.ascii_split_whitespace(column)
        last = 2 * np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)])
        coded = words.flatten().dictionary_encode()
        del words
        stems, known = coded.dictionary, len(coded.dictionary)
        marks = pa.array([""] * known)
        if self.plain_rules:
            bare = pc.replace_substring_regex(stems, r"^([A-Za-z]+)[.,;:!?]$", r"\1")
            marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(stems))
            marks = pc.if_else(marked, pc.binary_slice(stems.cast(pa.binary()), -1), pa.scalar(b"", pa.binary()))
            stems = pc.if_else(pc.match_substring(bare, "<|"), bare, pc.ascii_lower(bare))
        parts = pa.concat_arrays([stems.cast(pa.binary()), marks.cast(pa.binary())]).dictionary_encode()
        found = self._words(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        # Two parts for each word of the block, in order.
        place = parts.indices.to_numpy().reshape(2, known).T[coded.indices.to_numpy()].ravel()
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        del coded, parts, stems, marks, found
        pa.default_memory_pool().release_unused()
        n = sizes[place]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        begins = (np.cumsum(sizes, dtype=np.int32) - sizes)[place]
        begins -= ends[:-1].astype(np.int32)
        cuts = ends[last].tolist()
        source = np.repeat(begins, n)
        del place, begins, n, ends
        source += np.arange(len(source), dtype=np.int32)
        data = ids[source]
        return [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Give back the memory of this worker's encoders; they are made anew when they are asked for."""
    _ENCODERS.clear()


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


# Files


def write_frames(stream, documents: Iterable[tuple[int, bytes]], level: int = 3) -> tuple[int, int]:
    """Write a token file of (doc_id, ids); the number of documents and ids."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    table, names, total = [], [], 0

    def frame(data: bytes) -> None:
        packed = packer.compress(data)
        stream.write(packed)
        table.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    for doc_id, ids in documents:
        frame(ids)
        names.append(doc_id)
        total += len(ids) // 4
    frame(np.asarray(names, dtype="<i8").tobytes())
    rows = b"".join(table)
    stream.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(table), CHECKED, SEEKABLE))
    return len(names), total


class FrameReader:
    """Reads documents of a token file by their place or id; every frame is checked against its checksum."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("not a token file, or its end is missing")
        head = size - 9 - 12 * count - 8
        if head < 0 or struct.unpack("<II", self._at(head, 8)) != (SKIPPABLE, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self._at(head + 8, 12 * count), dtype="<u4").reshape(-1, 3).astype("int64")
        self.table, self.offsets = table, np.concatenate([[0], np.cumsum(table[:, 0])])
        self.doc_ids = np.frombuffer(self._frame(count - 1), dtype="<i8")
        #: Ids before each document of the file.
        self.starts = np.concatenate([[0], np.cumsum(table[:-1, 1] // 4)])

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def _frame(self, place: int) -> bytes:
        import xxhash

        packed, size, check = map(int, self.table[place])
        data = self.unpack.decompress(self._at(int(self.offsets[place]), packed), max_output_size=max(1, size))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {place} doesn't match its checksum")
        return data

    def document(self, place: int) -> np.ndarray:
        return np.frombuffer(self._frame(place), dtype="<u4")

    def find(self, doc_id: int) -> list[int]:
        """The places of a document's rows."""
        return np.flatnonzero(self.doc_ids == doc_id).tolist()


def open_output(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner, compression=None)


def open_input(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, docs_per_file: int = 1000) -> DataFrame:
    """Encode whole texts, append END_ID, and write files in ascending order of doc_id; the table of the files.

    Files are ranges of ids at quantiles. A file's name is new for each attempt of its task and only files of finished
    tasks are in the table, so a lost executor leaves no half-written file in it.
    Null texts count as empty, null ids come first, rows of one id follow one another; an id with more rows than a file
    holds has several files, by a hash of the text. Other columns, whatever their names, are left out. An empty table
    has no files.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    ids = keyed.select("doc_id")
    edges, hot = quantile_cuts(ids, "doc_id", bucket_count(ids.count(), docs_per_file, 1 << 14))
    ranged = keyed.withColumn("file", bucket_of(F.col("doc_id"), edges).cast("long") * (1 << 14) + part_of(F.col("doc_id"), F.col("text"), hot))
    dealt = ranged.repartition(F.col("file")).sortWithinPartitions("file", "doc_id", F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.asarray([END_ID], dtype="<u4").tobytes()

        def rows():
            for batch in batches:
                files, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for file, doc_id, ids in zip(files, doc_ids, encode.many(batch.column(2)), strict=True):
                    yield file, doc_id, ids + end

        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            file = ahead[0]

            def of_file():
                nonlocal ahead
                while ahead is not None and ahead[0] == file:
                    yield ahead[1], ahead[2]
                    ahead = next(todo, None)

            path = f"{folder}/tokens-{file:09d}-{uuid.uuid4().hex}.zst"
            with open_output(path) as stream:
                count, total = write_frames(stream, of_file())
            columns = [[file], [path], [count], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["file", "path", "n_docs", "n_tokens"])

    return dealt.select("file", "doc_id", "text").mapInArrow(write, "file long, path string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, files_per_task: int = 16) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens and the crc32 of its ids.

    ``start`` counts the ids of all documents before it; the files' own starts are a running sum over their table, which
    has one row for each file.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with open_input(path) as stream:
                    reader = FrameReader(stream, stream.size())
                    counts = reader.table[:-1, 1] // 4
                    checks = [zlib.crc32(reader._frame(i)) for i in range(len(reader.doc_ids))]
                    doc_ids = pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID)
                    arrays = [doc_ids, pa.array(reader.starts[: len(checks)] + base), pa.array(counts), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A given number of partitions, as the few bytes of a path stand for a whole file; tasks take it file by file.
    dealt = based.repartition(max(1, -(-files.count() // files_per_task)), "file")
    return dealt.select("file", "path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the documents of ``wanted`` (path, doc_id): only their frames are decompressed.

    A null doc_id stands for the documents without one. An id that a file has several times gives a row for each, one that it
    hasn't gives none, as do paths that aren't among ``files`` (path). An empty ``wanted`` gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as stream:
                    reader = FrameReader(stream, stream.size())
                    found = [reader.document(i).tolist() for i in reader.find(NO_ID if doc_id is None else doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    asked = wanted.join(files.select("path"), "path", "left_semi").select("path", "doc_id")
    return asked.mapInArrow(read, "doc_id long, ids array<bigint>")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read every document back from them.

    Null and empty texts have the end id alone, null ids come first, equal rows are documents of their own, other columns are
    left out, and an empty table gives an empty result.
    """
    folder = shared_path(docs.sparkSession, "token-files")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    files = materialise(write_token_files(docs, folder, tokenizer or default_tokenizer()), "token-file-table")
    return read_token_files(files)
