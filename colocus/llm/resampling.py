"""Importance resampling of documents towards the word distribution of a target.

Features are hashed runs of words. Long texts are cut into chunks at word boundaries, each with the n - 1
words after it as carry; a chunk counts the runs that start in its own part. Chunks are dealt out anew, and
their counts and weights are summed by document, so that one text never has to fit in one task.
"""

from __future__ import annotations

import math
import re
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, given_back, staged, table, text_batches

#: Bytes of text up to which a chunk is not cut.
CHUNK_BYTES = 1 << 16
#: Words whose hashes a task keeps at most.
CACHED = 400_000
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def cut(raw: bytes, n: int, size: int):
    """The chunks of a text: bytes with the carry at their end, and how many of them are the chunk's own."""
    at = 0
    while True:
        gap = _GAP.search(raw, at + size) if at + size < len(raw) else None
        stop = gap.start() if gap else len(raw)
        end = max((m.end() for m in islice(_WORD.finditer(raw, stop), n - 1)), default=stop) if n > 1 else stop
        yield raw[at:end], stop - at
        if stop >= len(raw):
            return
        at = stop


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = crc32(word)
        return h


class Features:
    """Buckets of the runs of 1 to n words that start in a chunk's own part."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, _Hashes()

    def of(self, chunk: bytes, own: int) -> tuple[int, np.ndarray]:
        """Words that the chunk owns, and the buckets of its features."""
        words = ascii_words(chunk)
        mine = len(words) if own == len(chunk) else len(ascii_words(chunk[:own]))
        hashes = list(map(self.known.__getitem__, words if self.n == 1 else words[:mine]))
        found = list(hashes)
        for k in range(1, self.n):  # from the runs of k words to those of one more
            hashes = [crc32(b" " + w, h) for h, w in zip(hashes, words[k:], strict=False)]
            found += hashes
        return mine, np.array(found, np.int64) % self.buckets


def _chunks(docs: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, key, chunk (its number), own and raw of every text in one or more chunks; key is null for one."""

    def run(batches):
        for whole in batches:
            for batch in text_batches(whole, 8):
                rows = [(d, k, c, own, part) for d, k, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c, (part, own) in enumerate(cut(raw, n, size))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "key", "chunk", "own", "raw"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    short = rows.where(F.length("raw") <= size).select("doc_id", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chunk"), F.length("raw").cast("long").alias("own"), "raw")
    long = rows.where(F.length("raw") > size).select("doc_id", F.unhex(F.md5("raw")).alias("key"), "raw")
    dealt = long.mapInArrow(run, "doc_id long, key binary, chunk long, own long, raw binary").repartition("doc_id", "key", "chunk")
    return short.unionByName(dealt)


def bucket_counts(docs: DataFrame, n: int, buckets: int, size: int = CHUNK_BYTES) -> np.ndarray:
    """Features of all texts in each bucket; `buckets` rows come to the driver at most."""

    def run(batches):
        features, total = Features(n, buckets), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in text_batches(whole):
                for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total += np.bincount(features.of(raw, own)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = _chunks(docs, n, size).select("own", "raw").mapInArrow(given_back(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, k in found.collect():
        out[bucket] = k
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, thousandths of the log of its smoothed frequency in the target by that in the source."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _floor_div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of the features, of every row of docs."""

    def run(batches):
        features = Features(n, len(gain))
        for whole in batches:
            for batch in text_batches(whole):
                found = [features.of(raw, own) for own, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
                numbers = ([w for w, _ in found], [len(x) for _, x in found], [int(gain[x].sum()) for _, x in found])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in numbers)], names)

    names = ["doc_id", "key", "chunk", "n_words", "n_features", "gain"]
    parts = _chunks(docs, n, size).mapInArrow(given_back(run), "doc_id long, key binary, chunk long, n_words long, n_features long, gain long")
    parts = staged(parts, "resampling-chunks")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]
    whole = parts.where("key is not null").groupBy("doc_id", "key").agg(*sums, F.count_if(F.col("chunk") == 0).alias("copies"))
    each = whole.select("doc_id", *[_floor_div(F.col(c), F.col("copies")).alias(c) for c in ("n_words", "n_features", "gain")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = parts.where("key is null").select("doc_id", "n_words", "n_features", "gain").unionByName(each.drop("col"))
    mean = F.when(F.col("n_features") > 0, _floor_div(F.col("gain"), F.greatest("n_features", F.lit(1)))).otherwise(0)
    return rows.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, size: int = CHUNK_BYTES) -> DataFrame:
    """Draws documents without replacement in proportion to how much likelier the target is to hold their words.

    docs has doc_id and text, target text; other columns are ignored. Every row of docs gives a row: doc_id,
    n_features, weight, score (weight and Gumbel noise from a hash of the id) and rank, which counts the drawn
    rows from the highest score and is null for others. Equal scores go by doc_id, null last. Null texts
    are empty: no features, weight 0, never drawn. Rows of one doc_id have the same noise; equal rows are
    drawn each for itself, in any order. An empty target or table of documents changes only the gains.

    Ranks need no sort of all rows: scores are integers in a range of some ten thousand, so counts by
    score are a small table, and only rows of one score are put in order.
    """
    gain = gains(bucket_counts(docs, n, buckets, size), bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets, size))
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((number + 0.5) / F.lit(4294967296.0))))
    rows = staged(weighted(docs, gain, n, size).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("able", F.col("n_words") >= least_words), "resampling-scores")
    by_score = rows.where("able").groupBy("score").agg(F.count("*").alias("k"))
    above = by_score.select("score", (F.sum("k").over(Window.orderBy(F.desc("score"))) - F.col("k")).alias("above"))
    drawn = percent * by_score.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] // 100
    place = F.col("above") + F.row_number().over(Window.partitionBy("score", "able").orderBy(F.asc_nulls_last("doc_id")))
    ranked = rows.join(F.broadcast(above.where(F.col("above") < drawn)), "score", "left").withColumn("place", F.when(F.col("able") & F.col("above").isNotNull(), place))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 1, 10_000, 20, 10, 2024)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: crc32 by a table of the 256 remainders, over the hexadecimal digits of each distinct word.
OP11_SQL = f"""
with doc_words as materialized (select doc_id, {_WORDS} ws from documents),
target_words as materialized (select unnest({_WORDS}) w from benchmark),
counted as materialized (select w, count(*) k from (select unnest(ws) w from doc_words) group by w),
vocabulary as (select w from counted union select w from target_words),
remainders as (
  select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, s: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) t from range(256) r(i)),
hashed as materialized (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(w)) + 1), lambda p: ('0x' || substr(hex(encode(w)), 2 * p - 1, 2))::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 bucket from vocabulary, remainders),
source as (select bucket, sum(k)::bigint s from counted join hashed using (w) group by bucket),
target as (select bucket, count(*) t from target_words join hashed using (w) group by bucket),
gains as materialized (
  select r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from source)::double + 10000)
    / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from target)::double + 10000))))::bigint gain
  from range(10000) r(bucket) left join source using (bucket) left join target using (bucket)),
word_gains as materialized (select w, gain from hashed join gains using (bucket)),
weighed as (
  select d.doc_id, d.n, coalesce(floor(g.total / nullif(d.n, 0)), 0)::bigint weight from (select doc_id, len(ws) n from doc_words) d left join (
    select doc_id, sum(gain)::double total from (select doc_id, unnest(ws) w from doc_words) join word_gains using (w) group by doc_id) g using (doc_id)),
scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score from weighed),
placed as (select *, row_number() over (order by n < 20, score desc, doc_id) place, count(*) filter (n >= 20) over () able from scored)
select doc_id, n n_features, weight, score, case when n >= 20 and place <= 10 * able // 100 then place end as rank from placed
"""
