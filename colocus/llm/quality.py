"""Weak supervision of text quality: rules vote or abstain, EM weighs them, posteriors decide.

Measures are computed once per text; every rule turns them into a vote for good (1), for bad (-1) or
none (0). Spark counts the distinct vote patterns, of which there are at most 3 to the number of
rules whatever the size of the input; expectation-maximisation runs on those counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, staged, table, text_batches

SYMBOLS = "#*$%&|<>"
_BLANK = re.compile(r"[\x20\x09-\x0D]")
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_strong", "n_stops"]

#: Rules: name, condition for a bad vote, condition for a good vote; else the rule abstains.
RULES = [
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    ("symbol_words", "n_symbols > 0.25 * n_words", "n_symbols < 0.05 * n_words"),
    ("letters", "n_letters < 0.7 * word_chars", "n_letters > 0.8 * word_chars"),
    ("repeats", "n_repeat_words > 0.25 * n_words", "n_repeat_words < 0.05 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    ("capitals", "n_upper > 0.4 * n_letters", "n_upper < 0.15 * n_letters"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    ("variety", "n_words >= 50 and n_distinct < 0.15 * n_words", "n_distinct > 0.35 * n_words"),
    ("strong_marks", "n_strong > 0.25 * n_words", "n_strong < 0.05 * n_words"),
    ("stops", "n_words >= 50 and n_stops < 0.01 * n_words", "n_stops between 0.03 * n_words and 0.4 * n_words"),
    ("length", "n_words < 20", "n_words >= 40"),
]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words are in some window of 8 words found at two or more places."""
    if len(ids) <= window:
        return 0
    w, k = ids, 1
    while k < window:  # a number for each distinct run of k words, by doubling
        _, w = np.unique(w[:-k] * (len(ids) + 1) + w[k:], return_inverse=True)
        k *= 2
    again = np.bincount(w)[w] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple:
    """The values of MEASURES for a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if _BLANK.sub("", x)] if "\n" in text else [text] * bool(words)
    low = text.lower()
    upper = sum(map(str.isupper, text)) if text != low else 0
    return (
        len(words), len(text) - len(_BLANK.findall(text)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ids),
        len(seen), upper, sum(map(str.isalpha, text)), text.count("!") + text.count("?"), sum(w[-1] in b".,;:!?" for w in words),
    )


def _measure(batches):
    for whole in batches:
        for batch in text_batches(whole):
            found = np.array([measures(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in found.T.copy())], ["doc_id", *MEASURES])


@dataclass
class RuleModel:
    """prior: share of good texts. good, bad: how often each rule's votes on good and on bad texts are right."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        up, down = np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)
        return np.log(self.prior / (1 - self.prior)) + (votes > 0) @ up + (votes < 0) @ down


def fit_rules(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> RuleModel:
    """EM on vote patterns with their counts, from doubt of every text with a bad vote.

    Each rule catches one kind of bad text and sees nothing wrong in the others, so a good vote may
    weigh little (bad from 0.02 up), but a bad vote always speaks against a text (good from 0.9 up
    and at most 0.9999). With no rows the model is the one that it starts from.
    """
    m = votes.shape[1]
    model = RuleModel(0.9, np.full(m, 0.99), np.full(m, 0.3))
    p = 0.1 ** (votes < 0).sum(axis=1) * 0.99
    for _ in range(rounds if counts.sum() else 0):
        g, b = counts * p, counts * (1 - p)
        new = RuleModel(
            float(np.clip((g.sum() + 9) / (counts.sum() + 10), 0.05, 0.99)),
            np.clip((g @ (votes > 0) + 99) / (g @ (votes != 0) + 100), 0.9, 0.9999),
            np.clip((b @ (votes < 0) + 3) / (b @ (votes != 0) + 10), 0.02, 0.9999),
        )
        moved = abs(new.prior - model.prior) + np.abs(new.good - model.good).max() + np.abs(new.bad - model.bad).max()
        model = new
        p = 1 / (1 + np.exp(-model.log_odds(votes)))
        if moved < 1e-9:
            break
    return model


def quality_posteriors(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """Measures, base test, posterior quality and verdict for every text.

    docs has doc_id and text; other columns are ignored. Returns doc_id, MEASURES, base_failed
    (n_words < 20, or over 30 % of the words in 8-word windows that repeat), posterior (of being
    good, 0 to 1) and kept (not base_failed, and posterior >= least). Null and empty texts have
    measures of 0 and fail the base test; repeated rows count each for itself; null doc_ids are kept
    as they are; an empty table gives an empty result.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    base = staged(rows.mapInArrow(given_back(_measure), "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES)), "quality")
    votes = {name: F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for name, bad, good in rules}
    voted = base.withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{name}" for name, _, _ in rules]
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    # What the base test settles does not teach the rules.
    patterns = voted.where(~failed).groupBy(*names).agg(F.count("*").alias("k")).collect()  # at most 3 ** len(rules) rows
    seen = np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(-1, len(names))
    model = fit_rules(seen, np.array([r["k"] for r in patterns], np.float64))
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, n in enumerate(names):
        up, down = float(np.log(model.good[k] / (1 - model.bad[k]))), float(np.log((1 - model.good[k]) / model.bad[k]))
        odds = odds + F.when(F.col(n) > 0, up).when(F.col(n) < 0, down).otherwise(0.0)
    out = voted.select("doc_id", *MEASURES, failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_posteriors(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
