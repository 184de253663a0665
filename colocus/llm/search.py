"""Ranked lexical search: the highest-scoring documents of every item of a query set.

A threshold-seeded join. An index of the query set's terms stores each term's largest and kth largest
impact; the kth impact of any of an item's terms is reached by k documents, so it bounds the item's kth score
from below. Terms whose largest impacts together stay under that bound can't bring a document in by
themselves and are left out of the join that generates candidates; every candidate is then scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, given_back, staged, table, text_batches

#: Bytes and rows of items that are searched for at a time; they go to all tasks.
BLOCK_BYTES, BLOCK_ITEMS = 4_000_000, 5_000
#: Impacts, of a batch's documents by the block's terms, that a task holds at a time.
CELLS = 4_000_000


@dataclass
class QuerySet:
    """A block of items: their ids, the terms of all of them, and each item's terms with their repeats."""

    ids: list
    terms: dict[bytes, int]
    of: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of_rows(rows: list) -> QuerySet:
        terms: dict[bytes, int] = {}
        of = []
        for row in rows:
            counts = Counter(terms.setdefault(w, len(terms)) for w in ascii_words(bytes(row["raw"] or b"")))
            of.append((np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))
        return QuerySet([row["item_id"] for row in rows], terms, of)


@dataclass
class TermIndex:
    """Documents and terms in all, and each term's weight, largest and kth largest impact."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    top: np.ndarray | None = None
    kth: np.ndarray | None = None

    def impacts(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray, b: int, k1: int) -> np.ndarray:
        m = 100 - b + b * length * self.n_docs // self.n_terms
        return self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + k1 * m))


def essential_terms(query: QuerySet, index: TermIndex) -> tuple[np.ndarray, list[np.ndarray]]:
    """A lower bound of each item's kth score, and those of its terms of which a document must hold one.

    The others' largest impacts sum to less than the bound, so that a document of them alone stays below it.
    """
    bounds, kept = np.zeros(len(query.of), np.int64), []
    for i, (terms, repeats) in enumerate(query.of):
        bounds[i] = (repeats * index.kth[terms]).max(initial=0)
        most = repeats * index.top[terms]
        order = np.argsort(most, kind="stable")
        kept.append(terms[order[np.cumsum(most[order]) >= bounds[i]]])
    return bounds, kept


def _matches(terms: dict[bytes, int]):
    """For every document with a term: its number of terms, and the query set's terms in it with their counts."""

    def run(batches):
        get = terms.get
        for whole in batches:
            for batch in text_batches(whole):
                kept, length, found, counts = [], [], [], []
                for at, raw in enumerate(batch.column(1).to_pylist()):
                    if words := ascii_words(raw or b""):
                        t, k = np.unique(np.array([x for w in words if (x := get(w)) is not None], np.int32), return_counts=True)
                        kept.append(at), length.append(len(words)), found.append(t.tobytes()), counts.append(k.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(length, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return given_back(run)


def _postings(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, its length, term and count of every posting in a batch of matches."""
    lists = batch.column(2).to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    terms, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (lists, batch.column(3).to_pylist()))
    return row, batch.column(1).to_numpy(zero_copy_only=False)[row], terms, tf


def _counts(n: int):
    """Documents of each term; at -1 all documents, at -2 all their terms."""

    def run(batches):
        df, docs, length = np.zeros(n, np.int64), 0, 0
        for batch in batches:
            _, _, terms, _ = _postings(batch)
            df += np.bincount(terms, minlength=n)
            docs, length = docs + batch.num_rows, length + int(batch.column(1).to_numpy(zero_copy_only=False).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([docs, length, *df[at].tolist()], pa.int64())], ["term", "k"])

    return run


def _largest(index: TermIndex, k: int, b: int, k1: int):
    """The k largest impacts of every term among a task's documents."""

    def run(batches):
        terms, most = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, length, t, tf = _postings(batch)
            terms, most = np.concatenate((terms, t)), np.concatenate((most, index.impacts(t, tf, length, b, k1)))
            order = np.lexsort((-most, terms))
            terms, most = terms[order], most[order]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            place = np.arange(len(terms)) - np.repeat(first, np.diff(first, append=len(terms)))
            terms, most = terms[place < k], most[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(most, pa.int64())], ["term", "impact"])

    return run


class _Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.doc, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        self.score, self.doc, self.none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        if len(self.score) > 10 * self.k:
            self.trim()

    def trim(self) -> None:
        order = np.lexsort((self.doc, self.none, -self.score))[: self.k]
        self.score, self.doc, self.none = self.score[order], self.doc[order], self.none[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _search(query: QuerySet, index: TermIndex, k: int, b: int, k1: int):
    """The k best of a task's documents for every item."""
    bounds, essential = essential_terms(query, index)
    n = len(query.terms)
    item = np.repeat(np.arange(len(essential)), [len(x) for x in essential])
    term = np.concatenate([*essential, np.zeros(0, np.int64)])
    order = np.argsort(term, kind="stable")
    items_of, ends = item[order], np.searchsorted(term[order], np.arange(n + 1))

    def run(batches):
        best = [_Best(k) for _ in query.of]
        for at, bound in enumerate(bounds.tolist()):
            best[at].floor = max(1, bound)
        for whole in batches:
            for batch in text_batches(whole, max(16, CELLS // max(n, 1))):
                row, length, t, tf = _postings(batch)
                impact = np.zeros((n, batch.num_rows), np.int64)
                impact[t, row] = index.impacts(t, tf, length, b, k1)
                doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                fan = ends[t + 1] - ends[t]  # the join of postings and essential terms
                at = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(ends[t], fan)
                met = np.unique(items_of[at] * batch.num_rows + np.repeat(row, fan))
                owner = met // batch.num_rows
                starts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(met))
                for low, high in zip(starts, starts[1:], strict=False):
                    i, rows = owner[low], met[low:high] % batch.num_rows
                    terms, repeats = query.of[i]
                    score = repeats @ impact[terms][:, rows]
                    good = score >= best[i].floor
                    if good.any():
                        best[i].add(score[good], doc[rows[good]], none[rows[good]])
        out: tuple = ([], [], [])
        for i, found in enumerate(best):
            found.trim()
            for column, values in zip(out, ([i] * len(found.score), [None if no else d for d, no in zip(found.doc.tolist(), found.none.tolist(), strict=True)], found.score.tolist()), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "doc_id", "score"])

    return given_back(run)


def build_index(docs: DataFrame, query: QuerySet, k: int, b: int, k1: int) -> tuple[DataFrame, TermIndex]:
    """The stored matches of all documents with the query set's terms, and the terms' stored bounds."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    matches = staged(raw.mapInArrow(_matches(query.terms), "doc_id long, n long, terms binary, tfs binary"), "search-matches")
    n = len(query.terms)
    counts = {r["term"]: r["k"] for r in matches.mapInArrow(_counts(n), "term long, k long").groupBy("term").agg(F.sum("k").alias("k")).collect()}
    docs_in_all = counts.get(-1, 0)
    weight = np.array([math.floor(1000 * math.log((2 * docs_in_all + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n)], np.int64)
    index = TermIndex(docs_in_all, max(1, counts.get(-2, 0)), weight)
    largest = matches.mapInArrow(_largest(index, k, b, k1), "term long, impact long")
    ranked = largest.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
    bounds = ranked.groupBy("term").agg(F.max("impact").alias("top"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth")).collect()
    index.top, index.kth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for term, top, kth in bounds:
        index.top[term], index.kth[term] = top, kth
    return matches, index


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 20, b: int = 25, k1: int = 12, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The k documents with the highest score above 0 of every item: item_id, rank, doc_id and score.

    items has item_id and text, docs doc_id and text; other columns are ignored. b (per cent) and k1 (tenths
    of a hundredth) are the constants of the term weighting. Equal scores go by doc_id, null last. Every row
    is an item or document of its own, also with null or repeated ids; null and empty texts have no terms, so
    such items have no rows and such documents do not count. Empty tables give an empty result.

    Items are dealt into blocks of a bounded size by a hash, and a block is searched for at a time in all
    documents: it goes to every task, with the bounds of its terms. A task keeps k documents an item.
    """
    spark = docs.sparkSession
    queries = items.select("item_id", F.col("text").cast("string").cast("binary").alias("raw"))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes), -(-size["n"] // block_items))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)))
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        query = QuerySet.of_rows(dealt.where(F.col("block") == block).collect())
        matches, index = build_index(docs, query, k, b, k1)
        best = matches.mapInArrow(_search(query, index, k, b, k1), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(query.ids)), f"item long, item_id {kind}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.union(part)
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 20, 25, 12)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
with lists as materialized (select doc_id, {_TERMS} ts from documents),
lengths as (select doc_id, len(ts) n from lists where len(ts) > 0),
stats as materialized (select count(*) n_docs, sum(n)::bigint n_terms from lengths),
item_terms as materialized (select item_id, t, count(*) repeats from (select item_id, unnest({_TERMS}) t from benchmark) group by all),
postings as materialized (select doc_id, t, count(*) tf from (select doc_id, unnest(ts) t from lists) where t in (select t from item_terms) group by all),
weights as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w from postings, stats group by t, n_docs),
impacts as materialized (
  select doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) impact from postings join lengths using (doc_id) join weights using (t), stats),
scores as (select item_id, doc_id, sum(repeats * impact)::bigint score from item_terms join impacts using (t) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""
