"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the rows over its rows. Each document's
uniform number, a hash of seed and doc_id, is inverted through the Poisson distribution with that
mean; the document is repeated as often as that gives, and all copies are shuffled globally by a
hash. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Bytes of the table of rates up to which it may be broadcast; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 16 << 20
#: Rates over this are refused: the table of one source's distribution would grow too long.
MOST_RATE = 100_000
_OWN = ["copy", "shuffle_key"]


def source_rates(docs: DataFrame, power: float = 0.5, weights: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """source, n (rows) and rate (mean repetitions) for every source.

    Target weights are those given (0 for other sources), or in proportion to n to the power; they
    are brought to a sum of 1. The expected rows of the result are scale times the rows of docs. A null
    source is a source of its own.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        if not weights or min(weights.values()) < 0 or max(weights.values()) <= 0:
            raise ValueError("weights must not be negative, and one of them positive")
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("source")], F.lit(0.0))
    weighed = n.withColumn("weight", weight)
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    rows, whole = total["n"] or 0, total["weight"] or 1.0
    rate = F.col("weight") / F.lit(float(whole)) * F.lit(float(scale) * rows) / F.col("n")
    return weighed.select("source", "n", F.when(rate > MOST_RATE, F.raise_error(F.lit("a source's repetition rate is too large"))).otherwise(rate).alias("rate"))


def poisson_steps(rate: str) -> str:
    """SQL for the Poisson distribution function at 0, 1, ..., up to where it is 1 in doubles.

    The terms are kept as logarithms, so that large rates do not underflow.
    """
    last = f"cast(ceil({rate} + 12 * sqrt({rate}) + 30) as int)"
    return (
        f"aggregate(sequence(0, {last}), named_struct('log', 0D, 'sum', 0D, 'out', cast(array() as array<double>)),"
        f" (a, k) -> named_struct('log', case when k = 0 then -{rate} else a.log + ln({rate}) - ln(k) end,"
        f" 'sum', a.sum + exp(case when k = 0 then -{rate} else a.log + ln({rate}) - ln(k) end),"
        f" 'out', array_append(a.out, a.sum + exp(case when k = 0 then -{rate} else a.log + ln({rate}) - ln(k) end))), a -> a.out)"
    )


def uniform(seed: int, *columns: str) -> str:
    """SQL for a number from 0 up to 1 by a hash of seed and columns; nulls count as a value of their own."""
    text = " || ':' || ".join([f"'{int(seed)}'", *(f"coalesce(cast({c} as string), 'null')" for c in columns)])
    return f"cast(conv(substring(md5({text}), 1, 13), 16, 10) as double) / 4503599627370496D"


def mix_sources(docs: DataFrame, power: float = 0.5, weights: dict[str, float] | None = None, scale: float = 1.0, seed: int = 17) -> DataFrame:
    """Repeats every document by Poisson replication and shuffles all copies globally.

    docs has doc_id and source; all its columns are returned, but for any copy and shuffle_key of
    its own, with copy (1, 2, ...) and shuffle_key (rows are sorted by it within the partitions,
    which a hash of it fills). Rows with equal doc_ids are repeated alike; null doc_ids and sources
    count as a value of their own; texts are not looked at; an empty table gives an empty result.
    """
    docs = docs.drop(*_OWN)
    rates = staged(source_rates(docs, power, weights, scale).where("rate > 0").select(F.col("source").alias("__source"), F.expr(poisson_steps("rate")).alias("__steps")), "mix-rates")
    held = rates.agg(F.sum(F.size("__steps") * 8 + F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    small = held <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("__source")))
    times = F.expr(f"transform(array({uniform(seed, 'doc_id')}), u -> size(filter(__steps, c -> c < u)))[0]")  # one hash a row
    copies = joined.withColumn("__times", times).where("__times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    key = F.expr(f"cast(conv(substring(md5('{int(seed)}:' || coalesce(cast(doc_id as string), 'null') || ':' || copy), 1, 15), 16, 10) as long)")
    keyed = copies.drop("__source", "__steps", "__times").withColumn("shuffle_key", key)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), power=0.5, seed=17)


OP8_SQL = """
with n as (select source, count(*) n from documents group by source),
rate as (
  select source, sqrt(n) / (select sum(sqrt(n)) from n) * (select sum(n) from n) / n rate from n),
term as (
  select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) p
  from rate, (select unnest(range(0, 200)) k) where k <= ceil(rate + 12 * sqrt(rate) + 30)),
step as (select source, sum(p) over (partition by source order by k) c from term),
steps as (select source, list(c) cs from step group by source),
drawn as (
  select d.*, len(list_filter(cs, lambda c: c < ('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496)) times
  from documents d join steps s on d.source is not distinct from s.source),
copies as (select * exclude (times), unnest(range(1, times + 1))::int copy from drawn)
select *, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || copy), 1, 15))::bigint shuffle_key from copies
"""
