"""Column expressions for distances, likelihoods, codes and bins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: mixed() gives whole numbers from 0 up to MODULUS (a prime). Its rounds as (factor, mask) are fixed values that SQL uses too.
MODULUS = 2147483647
KEY_FACTORS = (69069, 1640531527, 12345)
ROUND = (1999999973, 0x2545F491)
LAST_ROUNDS = ((1812433253, 0x14057B7E), (1103515245, 0x369DEA0F))
#: Log density given to genomes too small for a uniform model.
TINY = 1e-20


def circular_distance(start1: Column, end1: Column, start2: Column, end2: Column, size: Column, same: Column) -> Column:
    """Base pairs spanned by two genes on a circular molecule, the shorter way; a gene's own length if same."""
    ahead = start1 <= start2
    first_start, first_end = F.when(ahead, start1).otherwise(start2), F.when(ahead, end1).otherwise(end2)
    second_start, second_end = F.when(ahead, start2).otherwise(start1), F.when(ahead, end2).otherwise(end1)
    return F.when(same, end1 - start1 + 1).otherwise(F.least(second_end - first_start + 1, size - second_start + first_end + 1))


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.least(end1, end2) - F.greatest(start1, start2) > 0


def _rate(rate) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("the rate of an exponential must be positive")).cast("double"))


def log_exponential(distance: Column, rate) -> Column:
    rate = _rate(rate)
    return F.ln(rate) - rate * distance


def exponential(distance: Column, rate) -> Column:
    rate = _rate(rate)
    return rate * F.exp(-rate * distance)


def log_uniform(half: Column, least: float = 100.0) -> Column:
    return F.when(half >= least, F.ln(1.0 / half)).otherwise(F.ln(F.lit(TINY)))


def posterior(log_exp: Column, log_uni: Column, phi: float, stable: bool = False) -> Column:
    """Probability of the clustered model. If both terms underflow, 1 or 0 by comparison, or exact with stable."""
    odds = F.lit(phi / (1 - phi))
    if stable:
        return 1 / (1 + F.exp(-(F.ln(odds) + log_exp - log_uni)))
    nom, other = F.lit(phi) * F.exp(log_exp), F.lit(1 - phi) * F.exp(log_uni)
    wins = (F.ln(F.lit(phi)) + log_exp > F.ln(F.lit(1 - phi)) + log_uni).cast("double")
    return F.when(nom + other == 0, wins).otherwise(nom / F.nullif(nom + other, F.lit(0.0)))


def probability_code(p: Column) -> Column:
    """A small integer: thousandths from 0.001 on, else the exponent of ten."""
    exponent = F.floor(F.log10(F.nullif(p, F.lit(0.0))))
    return F.when(p == 0, 0).when(p == 1, 1000).when(exponent >= -3, (p * 1000).cast("int")).otherwise(exponent.cast("int")).cast("smallint")


def decoded_probability(code: Column) -> Column:
    return F.when(code >= 0, code / F.lit(1000.0)).otherwise(F.pow(F.lit(10.0), code))


def label_code(label: Column) -> Column:
    """The second word of a label, up to its first dot; underscores count as spaces."""
    return F.substring_index(F.element_at(F.split(F.regexp_replace(label, "_", " "), " "), 2), ".", 1)


def _decade(n: Column) -> Column:
    return F.pow(F.lit(10.0), F.floor(F.log10(n.cast("double")) + 1e-12)).cast("long")


def occurrence_bins(n: Column) -> Column:
    """All bins that a number of occurrences counts for: its decade, five times it, and half of it from 10 on."""
    b = _decade(n)
    return F.array_compact(F.array(b, F.when(n >= 5 * b, 5 * b), F.when(b >= 10, (b / 2).cast("long"))))


def single_bin(n: Column) -> Column:
    b = _decade(n)
    return F.when(n >= 5 * b, 5 * b).otherwise(b)


def pair_key(a: Column, b: Column) -> Column:
    """The two accessions in order, without the PF prefix, joined by an underscore."""
    a, b = (F.regexp_replace(c.cast("string"), "PF", "") for c in (a, b))
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def decimal_log(x: Column) -> Column:
    """log10; null where x is not positive."""
    return F.when(x > 0, F.log10(x))


def scaled_weight(score: Column, low: Column, high: Column, n: Column) -> Column:
    """Scores brought to the range from 1/n to 1 within a subclade; all 1 if they hardly differ."""
    spread = high - low
    return F.when((n == 1) | (spread < 1e-6), 1.0).otherwise((score - low) / F.nullif(spread, F.lit(0.0)) * (1 - 1 / n) + 1 / n)


def log_spaced(low: float, high: float, n: int) -> list[float]:
    """n values from low to high at equal steps of the logarithm."""
    if low <= 0 or high <= low:
        raise ValueError("bounds must be positive and in order")
    return [low] if n == 1 else [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def _round(h, factor: int, mask: int):
    """A product modulo a prime of h with some bits turned, which no sum of keys passes through in line."""
    turned = h.bitwiseXOR(F.lit(mask).cast("long")) if isinstance(h, Column) else h ^ mask
    return turned * factor % MODULUS


def mixed_keys(seed, *keys):
    """The first half of mixed(), to which further keys can be given in place of a seed."""
    a, b, c = KEY_FACTORS
    h = seed % MODULUS if isinstance(seed, int) else seed
    for key in keys:
        key = key.cast("long") if isinstance(key, Column) else key
        h = _round((h * a + key * b + c) % MODULUS, *ROUND)
    return h


def mixed(seed, *keys):
    """A whole number from 0 up to MODULUS that the keys decide, by arithmetic that every engine has.

    Keys are whole numbers, columns of such or numpy arrays, from 0 up to 2**31.
    """
    h = mixed_keys(seed, *keys)
    for last in LAST_ROUNDS:
        h = _round(h, *last)
    return h


def poisson_limits(most: int = 12) -> list[int]:
    """The numbers from which on poisson_count is 1, 2 and so on up to `most`; more has no chance worth a bit."""
    share, below, limits = math.exp(-1), 0.0, []
    for k in range(most):
        below += share
        limits.append(int(below * MODULUS))
        share /= k + 1
    return limits


def poisson_count(number: Column, most: int = 12) -> Column:
    """A count of mean 1 from a number that is even from 0 up to MODULUS."""
    return reduce(lambda x, y: x + y, [(number >= limit).cast("int") for limit in poisson_limits(most)])


def poisson_counts(seed: int, samples: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """poisson_count of mixed(seed, sample, key) for every sample, down, and key, across, as doubles.

    As MODULUS is 2**31 - 1, a product's rest is the sum of its upper and lower 31 bits, less MODULUS if not below it.
    """
    a, b, c = KEY_FACTORS
    whole, limits = np.uint32(MODULUS), np.array(poisson_limits(), "uint32")
    first, second = mixed_keys(seed, samples.astype("int64")) * a % MODULUS, (keys.astype("int64") * b + c) % MODULUS
    x = first.astype("uint32")[:, None] + second.astype("uint32")
    y, t, u = np.empty_like(x), np.empty(x.shape, "uint64"), np.empty(x.shape, "uint64")
    np.minimum(x, np.subtract(x, whole, out=y), out=x)  # below 0 is above all
    for factor, mask in (ROUND, *LAST_ROUNDS):
        t[...] = np.bitwise_xor(x, np.uint32(mask), out=x)
        np.right_shift(np.multiply(t, np.uint64(factor), out=t), np.uint64(31), out=u)
        x[...] = np.add(np.bitwise_and(t, np.uint64(MODULUS), out=t), u, out=t)
        np.minimum(x, np.subtract(x, whole, out=y), out=x)
    count = np.zeros(x.shape, "uint8")
    for limit in limits[:4]:
        count += (x >= limit).view("uint8")
    more = np.flatnonzero(x >= limits[4])
    count.ravel()[more] = np.searchsorted(limits, x.ravel()[more], "right")
    return count.astype(float)
