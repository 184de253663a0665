"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The document-by-n-gram incidence matrix is cut into column blocks (ranges of the n-gram hash) and
row blocks (groups of documents). A document that links needs all but a few of its n-grams in some
other document, so a first column block already discards every document with more unmatched
n-grams in it than that bound allows. The rest are grouped by the rarest n-grams that a partner
must share. A group that is too large for one row block is cut into blocks of documents of like size,
and only blocks whose sizes allow a link are multiplied: overlap counts are accumulated column by column and pairs under the bound that
both sizes imply are discarded. Equal sets are one row of the matrix with their number as weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from .common import Union, connected_components, give_back, given_back, mix64, small_side, staged, table, text_batches

#: The words that a task's cache of word hashes holds at most.
CACHED_WORDS = 200_000
#: N-grams of a row block at most, but for a single set of more.
BLOCK_GRAMS = 1 << 18


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, words: dict, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of text, A-Z lower-cased.

    With fewer than n words the whole sequence counts as one n-gram; with none the array is empty.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(w) < n:
        return np.array([xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = mix64(h) + w[k : len(w) - n + 1 + k]
    return np.unique(mix64(h))


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """An Arrow list<int64> column; None gives a null list."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    if ends[-1] >= 2**31:
        raise ValueError("a slice of documents holds too many n-grams")
    flat = np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.uint64)])
    off = pa.array(ends.astype(np.int32), mask=np.array([*(a is None for a in arrays), False]))
    return pa.ListArray.from_arrays(off, pa.array(_long(flat), pa.int64()))


def _fingerprints(n: int):
    def run(batches):
        words, seen = _Words(), set()
        for whole in batches:
            for batch in text_batches(whole):
                sizes, fps, heads = [], [], []
                for text in batch.column(2).to_pylist():
                    h = shingle_hashes(text, words, n)
                    fp = xxh3_128_intdigest(h.tobytes())
                    sizes.append(len(h))
                    fps.append(fp)
                    heads.append(None if fp in seen or not len(h) else h[: np.searchsorted(h, np.uint64(1 << 62))])
                    seen.add(fp)
                fp = np.array([(x >> 64, x & (2**64 - 1)) for x in fps], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(_long(fp[:, 0].copy())), pa.array(_long(fp[:, 1].copy())), _lists(heads)],
                    ["doc_id", "th", "n", "fp", "fp2", "head"],
                )

    return run


def _sets(n: int):
    def run(batches):
        words, seen = _Words(), set()
        for whole in batches:
            for batch in text_batches(whole):
                sets = {xxh3_128_intdigest((h := shingle_hashes(t, words, n)).tobytes()): h for t in batch.column(0).to_pylist()}
                sets = {fp: h for fp, h in sets.items() if fp not in seen}
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(_long(np.array([fp >> 64 for fp in sets], np.uint64))), _lists(list(sets.values()))], ["fp", "grams"])

    return run


def _product(share: int):
    """Multiplies two row blocks of a group, or one by itself.

    Returns the weight linked to each row (a, n), and links (a, b) that join their documents' components.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = multiplied(key, pdf)
        if pdf["n"].sum() > 1 << 16:
            give_back()
        return found

    def multiplied(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "fp"])
        ids, m, block, size = (pdf[c].to_numpy(np.int64) for c in ("fp", "m", "block", "n"))
        sets = [np.asarray(x, np.int64) for x in pdf["grams"]]
        rows = np.repeat(np.arange(len(ids)), size)
        columns, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        rows_of, starts = rows[by], np.searchsorted(inverse[by], np.arange(len(columns) + 1))
        own, parts, links, linked = np.split(inverse, np.cumsum(size)[:-1]), Union(len(ids)), [], np.zeros(len(ids), np.int64)
        two = key[1] != key[2]
        for i in range(1, len(ids)):
            held = np.concatenate([rows_of[starts[c] : starts[c + 1]] for c in own[i]])
            overlap = np.bincount(held[held < i], minlength=i)
            ok = 100 * overlap >= share * (size[:i] + size[i] - overlap)
            if two:
                ok &= block[:i] != block[i]
            at = np.flatnonzero(ok)
            linked[i] += m[at].sum()
            linked[at] += m[i]
            links += [(i, j) for j in at.tolist() if parts.join(i, j)]
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        some = linked > 0
        none = pd.array([None] * int(some.sum()), "Int64")
        return pd.concat([pd.DataFrame({"a": ids[i], "b": pd.array(ids[j], "Int64"), "n": 0}), pd.DataFrame({"a": ids[some], "b": none, "n": linked[some]})])

    return run


def _joined(docs: DataFrame, n: int, share: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """All rows with the size and fingerprint of their set; and every set's links, component and first row.

    A component is named by the least fingerprint in it. lead is a set's first row by doc_id, then by a
    hash of its text; rows without a doc_id come last.
    """
    if not 50 < share <= 100 or n < 1:
        raise ValueError("share must be in (50, 100] and n positive")
    misses = F.expr(f"n - (({share} * n + 99) div 100)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    base = staged(rows.mapInArrow(given_back(_fingerprints(n)), "doc_id long, th long, n long, fp long, fp2 long, head array<long>"), "ngram-base")

    # First column block: n-grams that no other set holds, counted per set.
    lone = (
        base.select("fp", F.explode("head").alias("gram"))
        .groupBy("gram").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")).where("fp = last")
        .groupBy("fp").agg(F.count("*").alias("lone"))
    )
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead")
    classes = staged(base.where("n > 0").groupBy("fp", "fp2", "n").agg(lead, F.count("*").alias("m")), "ngram-classes")
    kept = classes.join(lone, "fp", "left").where(F.coalesce("lone", F.lit(0)) <= misses).select(F.col("lead.doc_id").alias("id_"), F.col("lead.th").alias("th_"))
    kept = small_side(staged(kept, "ngram-kept"))

    # All columns, for the documents still in question.
    texts = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left_semi")
    sets = staged(texts.select("text").mapInArrow(given_back(_sets(n)), "fp long, grams array<long>"), "ngram-sets")
    if not sets.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").isEmpty():  # equal rows with one doc_id
        sets = staged(sets.groupBy("fp").agg(F.first("grams").alias("grams")), "ngram-sets")
    sets = sets.withColumn("n", F.size("grams").cast("long"))
    cells = sets.select("fp", "n", F.explode("grams").alias("gram"))
    count = cells.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = cells.join(count, "gram")
    order = Window.partitionBy("fp").orderBy("df", "gram")
    whole = Window.partitionBy("fp")
    # A partner shares at least one of a set's rarest (misses + 1) n-grams; the unshared ones come first.
    prefix = staged(
        shared.withColumns({"at": F.row_number().over(order), "held": F.count("*").over(whole)})
        .where(F.col("at") + F.col("n") - F.col("held") <= misses + 1)
        .select("fp", "gram"),
        "ngram-prefix",
    )
    hubs = prefix.groupBy("gram").agg(F.min("fp").alias("hub"), F.count("*").alias("k")).where("k > 1")
    near = prefix.join(hubs, "gram").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    groups = connected_components(near).withColumnsRenamed({"node": "fp", "component": "cluster"})

    # Row blocks: of a group that is too large for one, the sets by size, in ranges whose ends are as far
    # apart as linked sets can be, and each range in blocks. A block meets those of its own range and the next.
    width = float(np.log(100 / share)) + 1e-9 if share < 100 else 1e-9
    sized = staged(groups.join(sets.select("fp", "n"), "fp"), "ngram-groups")
    needed = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / BLOCK_GRAMS))
    small = sized.groupBy("cluster").agg((needed == 1).alias("small"))
    sized = sized.join(small, "cluster").withColumn("range", F.when(F.col("small"), 0).otherwise(F.floor(F.ln("n") / width)))
    ranges = sized.groupBy("cluster", "range").agg(F.count("*").alias("k"), needed.alias("n_blocks"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.col("range") * 2**32 + i)
    ranges = ranges.select("cluster", "range", "k", blocks.alias("blocks"))
    others = ranges.select("cluster", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range"), F.col("range").alias("other"), F.col("blocks").alias("others"))
    partners = ranges.join(others, ["cluster", "range"]).where("range <> other or k > 1").select("cluster", "range", F.size("blocks").alias("n_blocks"), F.explode("others").alias("other"))
    members = sized.drop("small").join(partners, ["cluster", "range"]).withColumn("block", F.col("range") * 2**32 + F.pmod(F.xxhash64("fp"), F.col("n_blocks")))
    pairs = members.select("fp", "cluster", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    held = pairs.join(sets, "fp").join(classes.groupBy("fp").agg(F.sum("m").alias("m")), "fp")
    found = staged(held.groupBy("cluster", "x", "y").applyInPandas(_product(share), "a long, b long, n long"), "ngram-links")
    linked = found.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "fp"})
    part = classes.join(labels, "fp", "left").join(linked, "fp", "left")
    part = part.select("fp", "fp2", "n", "lead", F.coalesce("component", "fp").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return base, part


def ngram_jaccard_groups(docs: DataFrame, n: int = 4, share: int = 85, block_rows: int = 512) -> DataFrame:
    """Groups documents linked by word n-gram Jaccard similarity of at least share percent.

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_shingles (size of the
    document's set), component_id, the smallest doc_id reachable by links, and n_links, the number of
    other rows linked directly. Exact: every pair with 100 * |intersection| >= share * |union| is in one
    component (up to collisions of 64-bit hashes). Null and empty texts have n_shingles 0 and stand
    alone; rows without a doc_id link as others do, and component_id is null where none of a component
    has one; rows with one doc_id are rows of their own; equal texts are one set and meet in one
    component; an empty table gives an empty result.
    """
    base, part = _joined(docs, n, share, block_rows)
    least = part.groupBy("component").agg(F.min("lead.doc_id").alias("least"))
    part = part.join(least, "component").select("fp", "fp2", "n", "least", "n_links")
    return base.select("doc_id", F.col("n").alias("n_shingles"), "fp", "fp2", "n").join(part, ["fp", "fp2", "n"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each_group(docs: DataFrame, n: int = 4, share: int = 85, block_rows: int = 512) -> DataFrame:
    """Keeps one row of each component of ngram_jaccard_groups, with all its columns.

    The row with the smallest doc_id stays (one of those where equal texts share it). Rows are told apart
    by doc_id and text, so that of different texts with one doc_id each stays if its component has no
    other. Texts without words all stay.
    """
    base, part = _joined(docs, n, share, block_rows)
    first = part.groupBy("component").agg(F.min("lead").alias("first"))
    known = base.select("doc_id", "th", "fp", "fp2", "n").join(part.join(first, "component").select("fp", "fp2", "n", "first"), ["fp", "fp2", "n"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    fate = staged(known.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).agg(F.max(stays).alias("stays"), F.count("*").alias("k")).where("not stays or k > 1"), "ngram-fate")
    marked = docs.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (F.col("__th") == F.col("th_"))
    out = marked.join(small_side(fate), met, "left_anti")
    again = fate.where("stays")
    if not again.isEmpty():
        out = out.unionByName(marked.join(again, met, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return out.select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"), n=4, share=85)


OP3_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (
  select doc_id, case when ws is null or len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end g
  from w),
sizes as (select doc_id, len(g) n from s),
cell as (select doc_id, unnest(g) gram from s),
held as (select gram from cell group by gram having count(*) > 1),
kept as (select c.doc_id, c.gram from cell c join held using (gram)),
pairs as (
  select a.doc_id x, b.doc_id y, count(*) inter from kept a join kept b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * inter >= 85 * (p.n + q.n - inter)),
two as (select x, y from link union all select y, x from link),
r(node, seen) as (select doc_id, doc_id from sizes union select two.y, r.seen from r join two on two.x = r.node),
reach as (select node, min(seen) component_id from r group by node),
direct as (select x, count(*) n_links from two group by x)
select doc_id, n::bigint n_shingles, component_id, coalesce(n_links, 0)::bigint n_links from sizes join reach on node = doc_id left join direct on x = doc_id
"""
