"""Sum-of-squares online packing of tokenized documents into windows.

Each task keeps one count for every fill level of its partly filled windows and puts the next piece
on the level for which the sum of the squared counts becomes least. Tasks pack what they read; no
row is shuffled. When a task's input ends, the pieces of its open windows are cut to fill each other.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, table, text_batches
from .tokens import CACHED, ODD_SPACE, Splitter, space_split, vocabulary_path

#: Bytes of a token id (unsigned, little-endian).
ID_BYTES = 4
#: Rows that a task encodes at a time.
ENCODED_ROWS = 1024


class Encoder:
    """Ids of texts by the tokenizer library, as bytes, with bounded caches of encoded words and parts.

    The library encodes new words many at a time, separated by spaces; a word's last token is marked
    as such in the vocabulary, which tells where the next word's ids begin.
    """

    JOINED = 256

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        splitter = Splitter(path)
        self.library, self.split = splitter.library, splitter.words
        # For words that are normalised and split already, the same model without those steps.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.cached = cached
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        # One text at a time: the library's encodings take far more memory than the ids in them.
        for k in range(0, len(words), self.JOINED):
            group = words[k : k + self.JOINED]
            ids = np.array(self.merges.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * ID_BYTES
            data, start = ids.tobytes(), 0
            if len(ends) != len(group):
                self.known.update((w, self.one(w)) for w in group)
                continue
            for word, end in zip(group, ends.tolist(), strict=True):
                self.known[word] = data[start:end]
                start = end

    def dictionary(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        for cache in (self.parts, self.known):
            if len(cache) >= self.cached:
                cache.clear()
        found = list(map(self.parts.get, parts))
        missed = [k for k, ids in enumerate(found) if ids is None]
        split = self.split
        new = [None if "<|" in parts[k] else split(parts[k]) for k in missed]
        self.learn(list(set(chain.from_iterable(w for w in new if w)).difference(self.known)))
        known, cache = self.known, self.parts
        for k, words in zip(missed, new, strict=True):
            if words is None:
                ids = self.one(parts[k])
            elif len(words) == 1:
                ids = known[words[0]]
            else:
                ids = b"".join([known[w] for w in words])
            found[k] = cache[parts[k]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        texts = pc.fill_null(texts, "")
        # A text in ASCII has the same ids in lower case, unless it may hold an added token.
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        lower = pc.if_else(plain, pc.ascii_lower(texts), texts)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        split = pc.ascii_split_whitespace(lower)
        if pc.any(odd).as_py():
            split = pa.array([space_split(t) if o else s for t, o, s in zip(lower.to_pylist(), odd.to_pylist(), split.to_pylist(), strict=True)], pa.list_(pa.string()))
        parts = split.flatten().dictionary_encode()
        ids = self.dictionary(parts.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = parts.indices.to_numpy()
        own = size[at]
        ends = np.concatenate(([0], np.cumsum(own)))
        place = np.repeat((first[at] - ends[:-1]).astype(np.int32), own)
        place += np.arange(ends[-1], dtype=np.int32)
        out = flat[place]
        offsets = split.offsets.to_numpy()
        return out, ends[offsets - offsets[0]]


class Windows:
    """The partly filled windows of one task, by fill level.

    A piece is (row, start, ids, doc_tokens), row being the document's id and copy.
    """

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)  # of windows filled so far; the last is always 0
        self.open: dict[int, list[list[tuple]]] = {}

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece shorter than a window; the pieces of the window that became full, if one did."""
        s = len(piece[2]) // ID_BYTES
        change = 2 * (self.level[s:] - self.level[: self.size + 1 - s]) + 2
        change[0] = 2 * self.level[s] + 1  # a new window
        change[-1] -= 1  # a full window leaves the count
        held = self.level[: self.size + 1 - s] > 0
        held[0] = True
        change[~held] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.open[at].pop() if at else []
        if at:
            self.level[at] -= 1
        window.append(piece)
        if at + s == self.size:
            return window
        self.level[at + s] += 1
        self.open.setdefault(at + s, []).append(window)
        return None

    def rest(self) -> list[list[tuple]]:
        """The open windows' pieces, cut to full windows; what is left goes to windows of powers of two."""
        pieces = [p for at in sorted(self.open, reverse=True) for w in self.open[at] for p in w]
        left = sum(len(p[2]) for p in pieces) // ID_BYTES
        pieces.reverse()
        out = []
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window: list[tuple] = []
            while room:
                row, start, ids, total = pieces.pop()
                n = min(room, len(ids) // ID_BYTES)
                window.append((row, start, ids[: n * ID_BYTES], total))
                if n * ID_BYTES < len(ids):
                    pieces.append((row, start + n, ids[n * ID_BYTES :], total))
                room -= n
            out.append(window)
        return out


def _pack(vocabulary: str, end_id: int, size: int, fields: list[pa.Field], cached: int):
    def run(batches):
        encoder, windows = Encoder(vocabulary_path(vocabulary), cached), Windows(size)
        serial = (TaskContext.get().partitionId() << 33) - 1
        end, ready = int(end_id).to_bytes(ID_BYTES, "little"), []

        def rows():
            nonlocal ready, serial
            got = {f.name: [] for f in fields}
            for window in ready:
                serial, offset = serial + 1, 0
                for row, start, ids, total in window:
                    n = len(ids) // ID_BYTES
                    for name, value in zip(got, (row, start, n, ids, total, serial, offset), strict=True):
                        got[name].append(value)
                    offset += n
            ready = []
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in fields], schema=pa.schema(fields))

        for whole in batches:
            for batch in text_batches(whole, ENCODED_ROWS):
                tokens, begin = encoder.encode(batch.column(1))
                for k, row in enumerate(batch.column(0).to_pylist()):
                    ids = tokens[begin[k] : begin[k + 1]].tobytes() + end
                    n = len(ids) // ID_BYTES
                    whole_windows = n - n % size
                    for j in range(0, whole_windows, size):
                        ready.append([(row, j, ids[j * ID_BYTES : (j + size) * ID_BYTES], n)])
                    if whole_windows < n and (full := windows.place((row, whole_windows, ids[whole_windows * ID_BYTES :], n))):
                        ready.append(full)
                if ready:
                    yield rows()
        ready = windows.rest()
        if ready:
            yield rows()

    return run


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, size: int = 2048, cached: int = CACHED) -> DataFrame:
    """Tokenizes every text, appends end_id and packs the ids into windows of at most size ids.

    docs has doc_id and text; other columns are ignored. Returns a row per piece: doc_id, start (ids
    of its document before it), length, ids (unsigned 32-bit, little-endian), doc_tokens (with
    end_id), sequence_id and offset (gapless from 0 in its sequence). Every id is in one piece.
    Sequences are full or, for the last few of a task, a power of two long. Null and empty texts are
    the end_id alone; rows with equal or null doc_ids are packed each for itself; an empty table
    gives an empty result. cached bounds each task's caches of encoded words: fewer take less memory
    and more time.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    fields = [
        pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids", pa.binary()),
        pa.field("doc_tokens", pa.int64()), pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()),
    ]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(given_back(_pack(vocabulary, end_id, size, fields, cached)), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1, 2048))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
