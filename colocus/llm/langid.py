"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language in the tasks and adds the counts in Spark; the matrix of
log probabilities has a fixed number of columns and a row per language and is broadcast. The n-grams of a
batch of texts form a sparse matrix of counts, which numpy multiplies with it at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, mix64, table, text_batches

#: The language of texts without letters.
UNKNOWN = "und"
#: Texts of a batch that are scored at once, and characters after which a batch ends early.
BATCH, BATCH_CHARS = 64, 400_000
#: A score is the posterior as if a text had this many n-grams of each order at most.
EVIDENCE = 20
_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(r"[^\p{L}\p{M}]+")


def gram_columns(text: str, orders: tuple[int, ...], columns: int) -> np.ndarray:
    """The column of every character n-gram of text, lower-cased, with anything but letters as one space."""
    codes = np.frombuffer(f" {_SPACE.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(1, max(orders) + 1):
        m = len(codes) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :] + np.uint64(k)
        if k in orders:
            out.append(mix64(h) & np.uint64(columns - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    """log_prob has a row per language in langs and a column per hashed n-gram."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of every text: one product of the batch's sparse counts and log_prob."""
        out, columns = [(UNKNOWN, 0.0)] * len(texts), self.log_prob.shape[1]
        which = [k for k, t in enumerate(texts) if t is not None and self.langs and _LETTER.search(t)]
        if not which:
            return out
        grams = [gram_columns(texts[k], self.orders, columns) for k in which]
        count = np.bincount(np.concatenate([g + k * columns for k, g in enumerate(grams)]), minlength=len(which) * columns)
        cell = np.flatnonzero(count)
        row, column = cell // columns, cell % columns
        starts = np.searchsorted(row, np.arange(len(which)))
        total = np.add.reduceat(self.by_column[column] * count[cell, None], starts, axis=0)
        best = (total + self.log_prior).argmax(axis=1)
        # N-grams of running text depend on each other: the share of the evidence that counts is bounded.
        size = np.array([len(g) for g in grams])
        p = total * np.minimum(1.0, EVIDENCE * len(self.orders) / size)[:, None] + self.log_prior
        p = np.exp(p - p.max(axis=1, keepdims=True))
        for k, b, q in zip(which, best, p / p.sum(axis=1, keepdims=True), strict=True):
            out[k] = self.langs[b], float(q[b])
        return out

    @cached_property
    def by_column(self) -> np.ndarray:
        return np.ascontiguousarray(self.log_prob.T)


def _counts(langs: list[str], orders: tuple[int, ...], columns: int):
    def run(batches):
        total = np.zeros((len(langs), columns), np.int64)
        row = {x: k for k, x in enumerate(langs)}
        for whole in batches:
            for batch in text_batches(whole):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[row[lang]] += np.bincount(gram_columns(text, orders, columns), minlength=columns)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    return run


def train(labelled: DataFrame, orders: tuple[int, ...] = (1, 2, 3), columns: int = 1 << 14, max_rows: int = 40_000, max_langs: int = 1000, smoothing: float = 0.5) -> LanguageModel:
    """Fits the model on labelled(doc_id, text, lang); rows with a null text or lang don't count.

    The n-gram counts come from at most about max_rows rows, taken evenly by a hash of doc_id (all
    rows if there are no more); the priors from all rows. More than max_langs languages, which would
    make the matrix too large to broadcast, are refused. No usable rows give a model without languages,
    for which every text is unknown.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(known) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(known)
    if not langs:
        return LanguageModel([], np.empty(0), np.empty((0, columns)), orders)
    # Rare languages keep all their rows; frequent ones share the rest of the bound.
    quota, left, todo = {}, max_rows, sorted(langs, key=lambda x: known[x])
    for k, lang in enumerate(todo):
        quota[lang] = min(known[lang], left // (len(todo) - k))
        left -= quota[lang]
    parts = 1 << 24
    keep = F.lit(False)
    for lang in langs:
        keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(np.ceil(parts * quota[lang] / known[lang])))
    cells = usable.where(keep).select("lang", "text").mapInArrow(given_back(_counts(langs, orders, columns)), "cell long, n long")
    counts = np.zeros(len(langs) * columns)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():  # at most a row for each cell of the matrix
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(len(langs), columns) + smoothing
    share = np.array([known[x] for x in langs], float)
    return LanguageModel(langs, np.log(share / share.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)), orders)


def _batches(batch):
    """Slices of an Arrow batch with its texts last, each of few texts and few characters."""
    texts = batch.column(batch.num_columns - 1).to_pylist()
    low = chars = 0
    for k, t in enumerate(texts):
        if k > low and (k - low >= BATCH or chars + len(t or "") > BATCH_CHARS):
            yield batch.slice(low, k - low), texts[low:k]
            low, chars = k, 0
        chars += len(t or "")
    if texts:
        yield batch.slice(low), texts[low:]


def _score(model, with_text: bool):
    def run(batches):
        m = model.value
        for whole in batches:
            for part in text_batches(whole):
                for batch, texts in _batches(part):
                    found = m.scores(texts)
                    more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                    n = batch.num_columns - (not with_text)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], *more], [*batch.schema.names[:n], "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Predicts the language of every text: the columns in keep, (text,) lang_pred and score.

    score is the posterior probability of lang_pred, from 0 to 1, with bounded evidence (EVIDENCE), so
    that it does not come to 1 by a text's length alone. Texts that are null or hold no
    letter get 'und' and 0, as do all texts where the model has no languages; equal scores go to the
    first language by name. Other columns never count; an empty table gives an empty result.
    keep must not name text, lang_pred or score.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep) + with_text])
    return rows.mapInArrow(given_back(_score(docs.sparkSession.sparkContext.broadcast(model), with_text)), f"{schema}, lang_pred string, score double")


def trained_on(docs: DataFrame, **how) -> LanguageModel:
    """The model learned from the documents that are not held out."""
    return train(docs.where(~held_out()), **how)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, trained_on(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
