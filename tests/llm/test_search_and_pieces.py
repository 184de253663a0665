import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colocus.llm import pieces, registry, resampling, search

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e " * 9000), (6, "Same text here now ok " * 6), (6, "Same text here now ok " * 6), (7, "ÉTÉ Σ İ <s>▁🎉 ab12"), (None, "the cat sat " * 9), (9, "x" * 200_000)]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def clashing(spark, rows, key="doc_id"):
    """Rows with further columns of the names that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], f"{key} long, text string, raw string, score double, n long")


def plain_resample(docs, target, n, buckets=10_000, least=20, percent=10):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    source, goal = Counter(), Counter()
    for _, t in docs:
        source.update(features(t))
    for t in target:
        goal.update(features(t))
    s, t = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able, 1) if k <= percent * len(able) // 100}
    return sorted(str((*r[:4], ranks.get(id(r)))) for r in out)


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 16), (1, 100), (3, 50), (3, 1 << 16)])
def test_resampling_by_brute_force(spark, n, size):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None]
    got = resampling.importance_resample(clashing(spark, docs), clashing(spark, list(enumerate(target))), n, percent=40, size=size)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_resample(docs, target, n, percent=40)


def test_resampling_edges(spark):
    docs, none = clashing(spark, ODD), clashing(spark, [(1, "x")]).limit(0)
    assert resampling.importance_resample(none, docs).isEmpty()
    assert sorted(str(tuple(r)) for r in resampling.importance_resample(docs, none, percent=100).collect()) == plain_resample(ODD, [], 1, percent=100)
    raw = ("ab cd, " * 40 + "x" * 90 + " éé y").encode()
    for n in (1, 2, 4):
        parts = list(resampling.cut(raw, n, 16))
        assert b"".join(p[:own] for p, own in parts) == raw and all(resampling.ascii_words(p[:own]) + resampling.ascii_words(p[own:]) == resampling.ascii_words(p) for p, own in parts)


def plain_search(items, docs, k):
    bags = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, length in bags:
            m = 75 + 25 * length * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, r in Counter(words(text)).items() if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("k", "items_at_a_time"), [(20, 5000), (3, 7)])
def test_search_by_brute_force(spark, k, items_at_a_time):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(3, "one one cat"), (None, "The THE the same"), (77, ""), (78, None), (79, "zzzz")]
    got = search.ranked_search(clashing(spark, items, "item_id"), clashing(spark, docs), k, block_items=items_at_a_time)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_search(items, docs, k)


def test_search_prunes_safely(spark):
    """Terms are left out of the join, and no more than may be: what remains still bounds every document's score."""
    items, docs = spark.read.parquet(f"{BIG}/benchmark.parquet"), spark.read.parquet(f"{BIG}/documents.parquet")
    query = search.QuerySet.of_rows(items.select("item_id", F.col("text").cast("binary").alias("raw")).collect())
    _, index = search.build_index(docs, query, 20, 25, 12)
    bounds, kept = search.essential_terms(query, index)
    dropped = 0
    for (terms, repeats), bound, essential in zip(query.of, bounds.tolist(), kept, strict=True):
        left = ~np.isin(terms, essential)
        dropped += left.sum()
        assert (repeats * index.top[terms])[left].sum() < max(bound, 1) and set(essential) <= set(terms)
    assert dropped > 0.1 * sum(len(t) for t, _ in query.of)
    best = {r["item_id"]: r["score"] for r in search.op12_ranked_search(spark, BIG).where("rank = 20").collect()}
    assert all(bound <= best[i] for i, bound in zip(query.ids, bounds.tolist(), strict=True))


def test_search_edges(spark):
    docs, items = clashing(spark, ODD), clashing(spark, [(1, "same")], "item_id")
    assert search.ranked_search(items.limit(0), docs).isEmpty() and search.ranked_search(items, docs.limit(0)).isEmpty()
    assert [r["doc_id"] for r in search.ranked_search(items, docs).collect()] == [6, 6]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_ranked_search"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{BIG}/{t}.parquet'")
    got = registry.QUERIES[name](spark, BIG)
    want = con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def model():
    return pieces.vocabulary_path("piece_bpe_32k.model")


def odd_texts(n=1500):
    rng = np.random.default_rng(4)
    pool = list(" ▁ab\n\t1é😀的ﬁ①　 Ａ\x00Σ") + ["the", "<s>", "</s>", "<0x0A>", "ing", "  "]
    return ["".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(n)] + ["", " ", "   ", "▁", "a" * 3000, " " * 500, "▁▁ x ▁"]


def against_library(path, texts):
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    for text in texts:
        raw = text.encode()
        ids, begins, ends = codec.encode(raw)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and codec.decode(want) == library.decode(want), text
        spans = [(0, 0), *((p.begin, p.end) for p in library.encode(text, return_type="proto").pieces), (len(raw), len(raw))]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == spans, text


def test_pieces_as_the_library(spark, model):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    against_library(model, texts + odd_texts())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("strip", "dummy"), [(True, True), (True, False), (False, True)])
def test_normalisation_with_a_character_map(tmp_path, model, rule, strip, dummy):
    """The same model with compiled maps that the library holds."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as format

    with open(model, "rb") as f:
        changed = format.ModelProto.FromString(f.read())
    changed.normalizer_spec.CopyFrom(format.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec)
    changed.normalizer_spec.remove_extra_whitespaces, changed.normalizer_spec.add_dummy_prefix = strip, dummy
    (tmp_path / "m").write_bytes(changed.SerializeToString())
    against_library(str(tmp_path / "m"), odd_texts())


def test_decoding_any_ids(model):
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), pieces.PieceCodec(model)
    rng = np.random.default_rng(5)
    for _ in range(1500):
        ids = rng.integers(0, rng.choice([300, 500, 32_000], rng.integers(1, 12))).tolist()
        assert codec.decode(ids) == library.decode(ids), ids


def test_piece_tables(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = pieces.piece_encoding(clashing(spark, ODD)).collect()
    assert len(got) == len(ODD) and pieces.piece_encoding(clashing(spark, ODD).limit(0)).isEmpty()
    texts = {i: t or "" for i, t in ODD}
    for r in got:
        ids, begins, ends = (np.frombuffer(bytes(r[c]), "<u4").tolist() for c in ("ids", "begins", "ends"))
        raw = texts[r["doc_id"]].encode()
        assert ids == library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True) and r["decoded"] == library.decode(ids)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw  # the spans tile the text
    for r in pieces.op13_sentencepiece(spark, SF).limit(20).collect():
        text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_take_bounded_memory(monkeypatch, model):
    """Long words that do not recur, and words with many cuts: what a task keeps of them goes by bytes, not by entries."""
    monkeypatch.setattr(pieces, "CACHED", 1 << 20)
    rng, codec = np.random.default_rng(6), pieces.PieceCodec(model)
    tracemalloc.start()
    try:
        for letters, size in (("etaoinshr", 2000), ("etaoinshr", 60_000), ("etao.,:é😀的", 500)):
            for _ in range(600_000 // size):
                codec.encode("".join(rng.choice(list(letters), size)).encode())
        codec.encode(" ".join("".join(rng.choice(list("etaoinshr"), 12)) for _ in range(20_000)).encode())  # all in one text
        assert tracemalloc.get_traced_memory()[0] < 2.5 * (1 << 20)
    finally:
        tracemalloc.stop()


def test_pieces_with_small_caches(monkeypatch, spark, model):
    monkeypatch.setattr(pieces, "CACHED", 20_000)
    against_library(model, [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()] + odd_texts(300))


def test_small_batches():
    values = [b"a" * n for n in (3, 0, 4, 30, 1, 9, 1)] + [None, b"", b"b" * 10]
    whole = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(values)], ["doc_id", "raw"])
    parts = list(pieces.small_batches(whole, 10))
    assert [x for p in parts for x in p.column(1).to_pylist()] == values and [x for p in parts for x in p.column(0).to_pylist()] == list(range(10))
    assert all(p.num_rows == 1 or 0 < p.num_rows and sum(len(x or b"") for x in p.column(1).to_pylist()) <= 10 for p in parts)
    assert not list(pieces.small_batches(whole.slice(0, 0), 10))
