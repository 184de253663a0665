"""Token counts by byte-pair merging with a heap over a linked list of symbols.

A word's count is its initial symbols less the merges made; no token ids are built. Words repeat,
so each task keeps a bounded cache of the counts of the white-space separated parts of a text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import given_back, table, text_batches

#: Characters that the tokenizer's \s takes for white space (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: White space besides ASCII's, and characters that only some take for it.
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Entries that each of a task's two caches, of words and of parts of texts, holds at most.
CACHED = 350_000


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def space_split(text: str) -> list[str]:
    """The parts of text between the tokenizer's white space."""
    if re.search("[\x1c-\x1f]", text):  # white space to str.split alone
        return [x for x in re.split(f"[{SPACE}]+", text) if x]
    return text.split()


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Splitter:
    """Splits the parts of texts into the words that are merged each for itself."""

    #: Characters on whose classes all versions of Unicode agree; the library splits parts with others.
    COMMON = re.compile("[\x00-\u036f\u0386-\u03ce\u0400-\u0481\u048a-\u0527\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")

    def __init__(self, path: str):
        self.path = path
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, part: str) -> list[str]:
        if part.isascii():
            low = part.lower()
            part = part if low == part else low  # one string object for both caches
        elif self.COMMON.fullmatch(part):
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        else:
            part = self.library.normalizer.normalize_str(part)
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        if part.isalpha():
            return [part]
        if part[-1:] in ".,;:!?" and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.pattern.findall(part)


class MergeCounter:
    """Counts the tokens of texts for a word-level BPE vocabulary file with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        shown = _byte_symbols()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + end] for c in shown]
        self.split = Splitter(path).words
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.parts: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols left after all merges of one word."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, pairs = len(ids), self.pairs
        if n == 1:
            return 1
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i] << 20 | ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapify(heap)
        left = n
        while heap:
            _, i, key, merged = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] << 20 | ids[j] != key:
                continue  # one of the pair has been merged since
            k = after[j]
            ids[i], ids[j], after[i], after[j] = merged, -1, k, -1
            left -= 1
            if k >= 0:
                before[k] = i
                if p := pairs.get(x := merged << 20 | ids[k]):
                    heappush(heap, (p[0], i, x, p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get(x := ids[h] << 20 | merged)):
                heappush(heap, (p[0], h, x, p[1]))
        return left

    def part(self, part: str) -> int:
        known, total = self.known, 0
        for word in self.split(part):
            n = known.get(word)
            if n is None:
                if len(known) >= CACHED:
                    known.clear()
                known[word] = n = self.word(word)
            total += n
        return total

    def plain(self, text: str) -> int:
        cache, total = self.parts, 0
        for part in space_split(text.lower() if text.isascii() else text):
            n = cache.get(part)
            if n is None:
                if len(cache) >= CACHED:
                    cache.clear()
                cache[part] = n = self.part(part)
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; the added tokens' strings in it are one token each."""
        if "<|" not in text:
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))


def _count(vocabulary: str):
    def run(batches):
        counter = MergeCounter(vocabulary_path(vocabulary))
        for whole in batches:
            for batch in text_batches(whole):
                texts = batch.column(1)
                counts = [counter.count(t or "") for t in texts.to_pylist()]
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), size, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Counts the tokens of every text, as the library for the vocabulary would, without ids.

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_bytes (UTF-8), n_tokens
    and over_limit (n_tokens > limit), one row for each row. Null and empty texts have none; null
    and repeated doc_ids are kept as they are; an empty table gives an empty result.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(given_back(_count(vocabulary)), "doc_id long, n_bytes long, n_tokens long").selectExpr("*", f"n_tokens > {int(limit)} over_limit")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)
