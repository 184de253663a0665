"""SentencePiece encoding with source spans, and decoding.

Normalisation takes the longest prefix that the model's compiled character map knows and records for every
normalised byte where it comes from; merging works on stretches of the normalised text that no piece of the
vocabulary crosses, which are cached. The recorded sources project every piece to bytes of the original text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, table, text_batches
from .tokens import vocabulary_path

#: The character that stands for a space in pieces (fixed value).
MARK = "▁"
#: Bytes that each of a task's two caches, of words and of stretches, holds at most.
CACHED = 128 << 20
#: Bytes of a cache's entry besides its text and its pieces.
ENTRY = 100
#: Rows, and bytes of their texts, up to which a task encodes texts at a time; one text may be longer.
ROWS, BYTES = 64, 1 << 20
#: Characters of a stretch up to which pairs are looked through, without a heap.
SHORT = 40
_NONE = float("inf")
#: What a cached entry holds of each piece: its id and the bytes of normalised text that it covers.
_PIECE = np.dtype([("id", "<u4"), ("size", "<u4")])

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """A compiled character map: a double-array trie over source bytes, and the texts that it points to.

    A unit of the array holds, from the low bits, a label of 8, whether a value follows, whether the offset
    is scaled by 256, and an offset; a value's unit holds a place in the texts, which end in 0 bytes.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        first = bytes(b for b in range(256) if self._step(0, b) is not None) if self.units else b""
        self.begins = re.compile(b"[" + re.escape(first) + b"]") if first else None

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << (8 if unit & 1 << 9 else 0)

    def _step(self, node: int, byte: int) -> int | None:
        to = node ^ self._offset(self.units[node]) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of raw from at, and what it becomes."""
        node, found = 0, None
        for k in range(at, len(raw)):
            node = self._step(node, raw[k])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                place = self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
                found = k + 1 - at, place
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray | None]:
        """raw with all known prefixes replaced, and the source byte of each of its bytes (None: each its own)."""
        if self.begins is None or not (m := self.begins.search(raw)):
            return raw, None
        out, sources, done = [], [], 0
        while m:
            at = m.start()
            if met := self.longest(raw, at):
                out += raw[done:at], met[1]
                sources += np.arange(done, at), np.full(len(met[1]), at)
                done = next_at = at + met[0]
            else:  # nothing known begins here: on to the next character
                next_at = at + 1
                while next_at < len(raw) and raw[next_at] & 0xC0 == 0x80:
                    next_at += 1
            m = self.begins.search(raw, next_at)
        out.append(raw[done:])
        sources.append(np.arange(done, len(raw)))
        return b"".join(out), np.concatenate(sources)


class Normaliser:
    """The model's normalisation, with the source of every byte."""

    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("models that keep spaces as they are, are not supported")
        self.map, self.dummy, self.strip = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def __call__(self, raw: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in raw that it comes from."""
        mapped, source = self.map.apply(raw)
        b = np.frombuffer(mapped, np.uint8)
        source = np.arange(len(b)) if source is None else source
        end = len(raw)
        space = b == 32
        if self.strip and space.any():
            keep = ~space | np.concatenate(([False], ~space[:-1]))  # a space after none
            b, source, space = b[keep], source[keep], space[keep]
        if not len(b) and (self.strip or not raw):
            return "", np.zeros(1, np.int64)
        source = np.repeat(source, np.where(space, 3, 1))
        text = b.tobytes().decode("utf-8", "replace").replace(" ", MARK)
        if self.dummy:
            first = 0
            if self.strip:  # the prefix comes after the spaces that go
                first = self._blank_prefix(raw)
            text, source = MARK + text, np.concatenate((np.full(3, first), source))
        if self.strip and text.endswith(MARK):
            text = text.rstrip(MARK)
            left = len(text.encode())
            end, source = int(source[left]), source[:left]
        return text, np.append(source, end)

    def _blank_prefix(self, raw: bytes) -> int:
        at = 0
        while at < len(raw):
            n, text = self.map.longest(raw, at) or (1, raw[at : at + 1]) if self.map.units else (1, raw[at : at + 1])
            if text != b" ":
                break
            at += n
        return at


class Cache:
    """What make gives for texts, kept by bytes in two generations: what is asked for again within the next one stays."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.limit = make, limit // 2
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def new(self, text: str) -> bytes:
        """What make gives for a text that is not among the known; one that is large beside the limit is not kept."""
        if (found := self.older.get(text)) is None:
            found = self.make(text)
        size = getsizeof(text) + getsizeof(found) + ENTRY
        if size <= self.limit // 16:
            if self.held + size > self.limit:
                self.older, self.known, self.held = self.known, {}, 0
            self.known[text] = found
            self.held += size
        return found


class PieceCodec:
    """Encodes and decodes with a byte-pair model of the library's format that falls back to bytes."""

    def __init__(self, path: str, begin: bool = True, end: bool = True):
        from sentencepiece import sentencepiece_model_pb2 as format

        with open(path, "rb") as f:
            model = format.ModelProto.FromString(f.read())
        trainer, kind = model.trainer_spec, model.SentencePiece
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only byte-pair models with byte fallback and marks before words are supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.normalise = Normaliser(model.normalizer_spec)
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.packed = {p.piece: np.array([(k, len(p.piece.encode()))], _PIECE).tobytes() for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.neighbours = {piece[k : k + 2] for piece in self.scores for k in range(len(piece) - 1)}
        at = {p.piece: k for k, p in enumerate(model.pieces)}
        self.before = np.array([at[trainer.bos_piece]] if begin else [], "<u4")
        self.after = np.array([at[trainer.eos_piece]] if end else [], "<u4")
        shown = {kind.NORMAL: lambda p: p.piece.replace(MARK, " "), kind.CONTROL: lambda p: "", kind.UNKNOWN: lambda p: trainer.unk_surface}
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == kind.BYTE else shown[p.type](p).encode() for p in model.pieces]
        self.silent = {k for k, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.marked = {k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL and p.piece.startswith(MARK)}
        self.stretches = Cache(self.merged, CACHED)
        self.words = Cache(lambda w: self.word(MARK + w), CACHED)

    def merged(self, stretch: str) -> bytes:
        """The pieces of a stretch: the best-scored pair of neighbours is merged first, the leftmost of equals."""
        parts = self._short(stretch) if len(stretch) <= SHORT else self._long(stretch)
        packed = self.packed
        try:
            return b"".join([packed[x] for x in parts])
        except KeyError:
            return b"".join([packed.get(x) or self._spelled(x) for x in parts])

    def _spelled(self, character: str) -> bytes:
        """A character without a piece: its bytes, the last of which covers it."""
        raw = character.encode()
        return np.array([(self.bytes[b], len(raw) if k == len(raw) - 1 else 0) for k, b in enumerate(raw)], _PIECE).tobytes()

    def _short(self, stretch: str) -> list[str]:
        """By looking through all pairs for each merge, which is the fastest way with few of them."""
        parts, score, none = list(stretch), self.scores.get, _NONE
        pairs = list(map(score, map(add, stretch, stretch[1:]), repeat(none)))
        while pairs and (best := min(pairs)) < none:
            k = pairs.index(best)
            parts[k] = piece = parts[k] + parts.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + piece, none)
            if k < len(pairs):
                pairs[k] = score(piece + parts[k + 1], none)
        return parts

    def _long(self, stretch: str) -> list[str]:
        """By a heap of pairs over a linked list."""
        parts: list[str | None] = list(stretch)
        n, scores = len(parts), self.scores
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p, k, stretch[k : k + 2]) for k in range(n - 1) if (p := scores.get(stretch[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j], after[i] = piece, None, after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if (p := scores.get(x := piece + parts[k])) is not None:
                    heappush(heap, (p, i, x))
            if (h := before[i]) >= 0 and (p := scores.get(x := parts[h] + piece)) is not None:
                heappush(heap, (p, h, x))
        return [x for x in parts if x is not None]

    def word(self, word: str) -> bytes:
        """The pieces of any text; one with other characters than letters is cut where no piece has the two side by side."""
        if word[1:].isalpha() and len(word) <= SHORT:
            return self.merged(word)
        neighbours, words, stretches = self.neighbours, self.words, self.stretches
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in neighbours]
        if not cuts:
            return self.merged(word)
        if word[0] == MARK:  # what comes before the first cut is a word that may be known
            head = word[1 : cuts[0]]
            out = [words.known.get(head) or words.new(head)]
        else:
            out = [self.merged(word[: cuts[0]])]
        cuts.append(len(word))
        out += [stretches.known.get(s := word[a:b]) or stretches.new(s) for a, b in zip(cuts, cuts[1:], strict=False)]
        return b"".join(out)

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in raw each begins and ends; a character's bytes but the last are empty at its begin."""
        text, source = self.normalise(raw)
        words, found = text.split(MARK), []
        if words[0]:
            found.append(self.word(words[0]))
        known = self.words.known
        if MARK * 2 in text or text.endswith(MARK):  # runs of marks belong to the word after them
            words = re.findall(f"{MARK}({MARK}*[^{MARK}]*)", text)
        else:
            del words[0]
        for w in words:
            x = known.get(w)
            if x is None:
                x, known = self.words.new(w), self.words.known
            found.append(x)
        pieces = np.frombuffer(b"".join(found), _PIECE)
        ends = np.cumsum(pieces["size"], dtype=np.int64)
        begins, ends = source[ends - pieces["size"]], source[ends]
        ids = np.concatenate((self.before, pieces["id"], self.after))
        close = np.full(len(self.after), len(raw))
        return ids, np.concatenate((np.zeros(len(self.before), np.int64), begins, close)), np.concatenate((np.zeros(len(self.before), np.int64), ends, close))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that the first word's mark stands for goes, bytes that are no UTF-8 are marked."""
        out = list(map(self.surface.__getitem__, ids))
        if self.normalise.dummy or self.normalise.strip:
            for k, x in enumerate(ids):
                if x in self.marked:
                    out[k] = out[k][1:]
                    if not self.normalise.strip or out[k]:
                        break
                elif x not in self.silent:
                    break
        return b"".join(out).decode("utf-8", "each-byte")


def small_batches(batch, limit: int):
    """Slices of an Arrow batch, none empty, whose second column's values take at most limit bytes together, or are one value."""
    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if k > start and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encoded(codec: PieceCodec, raw: bytes) -> tuple[bytes, bytes, bytes, str]:
    """A text's ids, begins and ends as unsigned 32-bit numbers, and the ids' decoded text."""
    found = codec.encode(raw)
    return *(x.astype("<u4").tobytes() for x in found), codec.decode(found[0].tolist())


def piece_encoding(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", begin: bool = True, end: bool = True) -> DataFrame:
    """Every text's ids with the spans of the original bytes that they cover, and the ids' decoded text.

    docs has doc_id and text; other columns are ignored. Returns, a row for each row, doc_id, ids, begins and
    ends (binary: unsigned 32-bit, little-endian) and decoded. The begin and end ids have empty spans at the
    text's ends. Null and empty texts are those two ids alone; null and repeated doc_ids are kept as they are;
    an empty table gives an empty result. A text takes about 30 times its size of memory while it is encoded;
    what a task keeps besides is bounded by bytes (CACHED).
    """

    def run(batches):
        codec = PieceCodec(vocabulary_path(vocabulary), begin, end)
        for whole in batches:
            for rows in text_batches(whole, ROWS):
                for batch in small_batches(rows, BYTES):
                    found = [encoded(codec, raw or b"") for raw in batch.column(1).to_pylist()]
                    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True))], ["doc_id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(given_back(run), "doc_id long, ids binary, begins binary, ends binary, decoded string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_encoding(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.crc32(F.concat("begins", "ends")).alias("spans_crc32"),
    )
