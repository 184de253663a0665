"""Secret scans: fixed patterns, and long tokens that pass a battery of randomness tests.

All of it is DataFrame functions. A token's encoding is inferred from its characters. Seven tests ask
whether its symbols are drawn evenly: chi-squared over symbols, over their classes, and over frequent
and rare letters; runs of classes and of vowels; serial correlation; and the first bits of the bytes that
it decodes to. Their p-values are combined. Discoveries are controlled by length: for each range of
lengths, ordinary names of many styles are made from a fixed list of words, and tokens are reported from
the value on that few names of any style reach. So what is reported of a text depends on that text alone.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEYWORD = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:({KEYWORD}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
#: Tokens that the tests look at; assignments are taken in first, so that tokens in their values are passed over.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
EITHER = rf"""(?i:{KEYWORD})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{6,}}|{TOKEN}"""
#: Lower bounds of the ranges of token lengths within which discoveries are controlled.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64, 96)
#: Names of each style and random strings of each alphabet that are made for each range.
MADE = 500

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The most frequent letters of running text, and the vowels.
FREQUENT, VOWELS = "etaoinsrlcdm", "aeiou"
#: Words and acronyms of ordinary names.
WORDS = (
    "account active add address agent all amount array async auth base batch block body border box buffer build button byte cache call cancel card case cell change channel char check child class clean "
    "click client clone close code color column command commit common config connect content context control copy count create current data date debug decode default delete depth detail device dialog "
    "disk display document domain double draw driver edit element email empty enable encode end engine entry error event exit export factory field file filter final find first flag folder format frame"
).split()
ACRONYMS = "ACL API ASCII AWS CDN CLI CPU CSS CSV DB DNS DOM DTO FTP GPU GUI HTML HTTP HTTPS ID IO IP JDBC JPEG JSON JVM JWT LDAP MIME OS PDF PNG RAM REST RPC SDK SHA SQL SSH SSL TCP TLS TTL UDP UI URI URL USB UTC UUID VM XML XSD ZIP".split()
#: Random strings are made of these.
ALPHABETS = {"b16": DIGITS + "ABCDEF", "b32": UPPER + "234567", "b36": DIGITS + UPPER.lower(), "B36": DIGITS + UPPER, "b62": DIGITS + UPPER + UPPER.lower(), "b64": DIGITS + UPPER + UPPER.lower() + "+/"}
_MATCHES = "array<struct<start:bigint,end:bigint,found:string>>"


def _once(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for value: a lambda over a one-element array computes it once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sums(numbers: str) -> str:
    """SQL for the running sums of an array of bigint, by folds over blocks of about the root of its size."""
    fold = "aggregate({0}, named_struct('at', {1}, 'out', cast(array() as array<bigint>)), (a, v) -> named_struct('at', a.at + v, 'out', array_append(a.out, a.at + v)), a -> a.out)"
    totals = fold.format("transform(parts, part -> aggregate(part, 0L, (a, v) -> a + v))", "0L")
    inside = fold.format("part", "case when b = 0 then 0L else totals[b - 1] end")
    body = _once("transform(sequence(0, size(w) div r), b -> slice(w, b * r + 1, r))", "parts", _once(totals, "totals", f"flatten(transform(parts, (part, b) -> {inside}))"))
    return _once(numbers, "w", _once("cast(ceil(sqrt(size(w) + 1)) as int)", "r", body))


def matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL for start, end and found (the group's text) of the matches of pattern, leftmost and non-overlapping."""
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    own, keys = (f"regexp_extract_all({text}, {quoted}, {g})" for g in (0, group))
    ends = running_sums("transform(m.own, (x, i) -> cast(length(m.gaps[i]) + length(x) as bigint))")
    rows = "transform(m.own, (x, i) -> named_struct('start', ends[i] - length(x), 'end', ends[i], 'found', m.keys[i]))"
    found = _once(f"named_struct('own', {own}, 'keys', {keys if group else own}, 'gaps', split({text}, {quoted}, -1))", "m", _once(ends, "ends", rows))
    return f"case when {text} rlike {quoted} then cast({found} as {_MATCHES}) else cast(array() as {_MATCHES}) end"


def _tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution at z >= 0 (a rational approximation, error under 1e-7)."""
    x, t = f"({z} / sqrt(2D))", f"(1D / (1D + 0.3275911D * {z} / sqrt(2D)))"
    return f"(0.5D * ((((1.061405429D * {t} - 1.453152027D) * {t} + 1.421413741D) * {t} - 0.284496736D) * {t} + 0.254829592D) * {t} * exp(-{x} * {x}))"


def _above(z: str) -> str:
    """SQL for the upper tail of the normal distribution at any z."""
    return f"case when {z} > 0 then {_tail(z)} else 1 - {_tail(f'(-{z})')} end"


def _fewer(text: str, marks: str) -> str:
    """SQL for the length of text after each run of one of the marks has become one mark."""
    for m in marks:
        text = f"regexp_replace({text}, '{m}+', '{m}')"
    return f"cast(length({text}) as double)"


def token_p_value(token: str) -> str:
    """SQL for the combined p-value of the hypothesis that the token is random, in the encoding that it shows.

    Small values mean order as names have it: uneven symbols, few changes of class, frequent letters, a
    vowel after each consonant, alike neighbours, or bytes of plain text once decoded.
    """
    lower = UPPER.lower()
    #: Condition, and the classes of symbols that make up the alphabet.
    encodings = [
        ("t rlike '^([0-9a-f]+|[0-9A-F]+)$'", (DIGITS, "abcdef")), ("t rlike '^[A-Z2-7]+$'", (UPPER, "234567")), ("t rlike '^[A-Z0-9]+$'", (DIGITS, UPPER)),
        ("t rlike '^[a-z0-9]+$'", (DIGITS, lower)), ("t rlike '^[A-Za-z0-9]+$'", (DIGITS, UPPER, lower)), ("true", (DIGITS + "+/", UPPER, lower)),
    ]

    def constants(classes: tuple[str, ...]) -> str:
        symbols = "".join(classes)
        letters = {c for c in symbols.lower() if c.isalpha()}
        marks = "".join(str(i) * len(c) for i, c in enumerate(classes))
        return f"named_struct('a', '{symbols}', 'classes', array({', '.join(map(repr, classes))}), 'marks', '{marks}', 'frequent', {len(letters & set(FREQUENT)) / len(letters)}D)"

    encoding = "case " + " ".join(f"when {c} then {constants(x)}" for c, x in encodings) + " end"
    text = "translate(case when length(e.a) = 16 then lower(t) else t end, '-_', '+/')"
    k, n = "length(e.a)", "cast(length(u) as double)"
    of = "cast(length(u) - length({0}) as double)"
    inside = of.format("translate(u, c, '')")
    squares = f"aggregate(split(e.a, ''), 0D, (acc, c) -> acc + pow({of.format('replace(u, c, {0})').format(repr(''))}, 2))"
    classes = f"aggregate(e.classes, 0D, (acc, c) -> acc + pow({inside} - {n} * length(c) / {k}, 2) / ({n} * length(c) / {k}))"
    power = lambda i: f"aggregate(e.classes, 0D, (acc, c) -> acc + pow({inside}, {i}))"
    letters = "regexp_replace(lower(u), '[^a-z]', '')"
    consonants = "".join(c for c in lower if c not in VOWELS)
    spoken = f"translate(w, '{VOWELS}{consonants}', '{'V' * len(VOWELS)}{'C' * len(consonants)}')"
    bytes_ = "regexp_replace(hex(unbase64(substring(u, 1, length(u) div 4 * 4))), '(.).', '$1')"
    plain = f"case when {k} >= 62 then {_once(bytes_, 'h', 'cast(length(h) - length(translate(h, {0}, {1})) as double)').format(repr('01234567'), repr(''))} else 0D end"
    stats = (
        f"named_struct('n', {n}, 'k', cast({k} as double), 'chi', {squares} * {k} / {n} - {n}, 'classes', {classes}, 'df', size(e.classes) - 1, 's2', {power(2)}, 's3', {power(3)},"
        f" 'runs', {_fewer('translate(u, e.a, e.marks)', '012')}, 'var', aggregate(x, 0D, (a, v) -> a + pow(v - m, 2)), 'cov', aggregate(sequence(1, size(x) - 1), 0D, (a, i) -> a + (x[i] - m) * (x[i - 1] - m)),"
        f" 'letters', cast(length(w) as double), 'often', cast(length(w) - length(translate(w, '{FREQUENT}', '')) as double), 'q', e.frequent,"
        f" 'vowels', cast(length(w) - length(translate(w, '{VOWELS}', '')) as double), 'spoken', {_fewer(spoken, 'VC')},"
        f" 'plain', {plain}, 'bytes', case when {k} >= 62 then length(u) div 4 * 3D else 0D end)"
    )
    expect, spread = "((s.n * (s.n + 1) - s.s2) / s.n)", "((s.s2 * (s.s2 + s.n * (s.n + 1)) - 2 * s.n * s.s3 - pow(s.n, 3)) / (s.n * s.n * (s.n - 1)))"
    pairs = "(2 * s.vowels * (s.letters - s.vowels))"
    apart = f"({pairs} * ({pairs} - s.letters) / (s.letters * s.letters * (s.letters - 1)))"
    # The symbols' chi-squared has the mean k - 1 and a variance that few symbols lessen: the cube root of a gamma.
    shape = "((s.k - 1) / 2 * s.n / (s.n - 1))"
    z = (
        f"named_struct('chi', (cbrt(greatest(s.chi, 0D) / (s.k - 1)) - 1 + 1 / (9 * {shape})) * sqrt(9 * {shape}),"
        f" 'runs', case when {spread} <= 1e-9 then 99D else ({expect} - s.runs) / sqrt({spread}) end, 'serial', case when s.var <= 0 then 99D else (s.cov / s.var + 1 / s.n) * sqrt(s.n) end,"
        f" 'often', case when s.letters = 0 then 0D else (s.often - s.letters * s.q) / sqrt(s.letters * s.q * (1 - s.q)) end,"
        f" 'spoken', case when s.letters < 4 or {pairs} <= s.letters then 0D else (s.spoken - {pairs} / s.letters - 1) / sqrt({apart}) end,"
        " 'plain', case when s.bytes = 0 then 0D else (s.plain - s.bytes / 2) / sqrt(s.bytes / 4) end)"
    )
    even = f"case when s.df = 2 then exp(-s.classes / 2) else 2 * {_tail('sqrt(s.classes)')} end"
    p = f"array({even}, " + ", ".join(_above(f"z.{name}") for name in ("chi", "runs", "serial", "often", "spoken", "plain")) + ")"
    fisher = "aggregate(p, 0D, (acc, v) -> acc - ln(greatest(v, 1e-60D)))"
    combined = _once(fisher, "y", "greatest(1e-60D, least(1D, exp(-y) * (1 + y * (1 + y / 2 * (1 + y / 3 * (1 + y / 4 * (1 + y / 5 * (1 + y / 6))))))))")
    numbers = "transform(split(u, ''), c -> instr(e.a, c) - 1)"
    mean = "(aggregate(x, 0D, (a, v) -> a + v) / size(x))"
    body = _once(stats, "s", _once(z, "z", _once(p, "p", combined)))
    return _once(token, "t", _once(encoding, "e", _once(text, "u", _once(letters, "w", _once(numbers, "x", _once(mean, "m", body))))))


def made_names() -> dict[str, str]:
    """SQL by style for an ordinary name, from the columns id and w (an array of words)."""
    drawn = lambda n: f"pmod(xxhash64(id, i, {n}), {n})"
    joined = lambda word, sep="": f"array_join(transform(w, (x, i) -> {word}), '{sep}')"
    some = lambda often, then, other: f"case when pmod(xxhash64(id, i, 'some'), 100) < {often} then {then} else {other} end"
    number = lambda n: f"cast({drawn(n)} as string)"
    acronym = f"element_at(array({', '.join(map(repr, ACRONYMS))}), cast({drawn(len(ACRONYMS))} as int) + 1)"
    coded = lambda words: f"translate(base64(encode({words}, 'UTF-8')), '\r\n', '')"
    return {
        "camel": joined("case when i = 0 then x else initcap(x) end"), "snake": joined("x", "_"), "upper": joined("upper(x)", "_"), "path": joined(some(30, "initcap(x)", "x"), "/"),
        "slug": joined(some(20, number(3000), "x"), "-"), "numbered": joined(some(30, f"concat(initcap(x), {number(1000)})", "initcap(x)")), "lower": joined(some(30, f"concat(x, {number(100)})", "x")),
        "acronyms": joined(some(50, acronym, "initcap(x)")), "lower_acronyms": joined(some(50, acronym, "x")), "base64": coded(joined("x", " ")), "base64_title": coded(joined(some(50, "initcap(x)", "x"), " ")),
    }


@lru_cache(maxsize=64)
def _least_values(spark: SparkSession, rate: float, miss: float) -> tuple[float, ...]:
    word = f"element_at(array({', '.join(map(repr, WORDS))}), cast(pmod(xxhash64(id, i), {len(WORDS)}) as int) + 1)"
    ids = spark.range(MADE).select("id", F.explode(F.array(*map(F.lit, LENGTHS))).alias("length")).withColumn("id", F.xxhash64("id", "length"))
    words = ids.withColumn("w", F.expr(f"transform(sequence(0, 44), i -> {word})"))
    random = {k: f"array_join(transform(sequence(1, length), i -> substring('{a}', cast(pmod(xxhash64(id, i, '{k}'), {len(a)}) as int) + 1, 1)), '')" for k, a in ALPHABETS.items()}
    kinds = [f"named_struct('kind', '{k}', 'name', {k in made_names()}, 'found', substring({x}, 1, length))" for k, x in (made_names() | random).items()]
    values = words.select("length", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("t")).select("length", "t.kind", "t.name", F.expr(token_p_value("t.found")).alias("p"))
    rows = values.groupBy("length", "kind", "name").agg(F.expr(f"percentile(p, {1 - rate / 2}D)").alias("names"), F.expr(f"percentile(p, {miss}D)").alias("random")).collect()
    return tuple(max(max(r["names"] for r in rows if r["length"] == n and r["name"]), min(r["random"] for r in rows if r["length"] == n and not r["name"])) for n in LENGTHS)


def least_values(spark: SparkSession, rate: float = 0.05, miss: float = 0.01) -> dict[int, float]:
    """For each range of LENGTHS (its lower bound), the combined p-value from which tokens are reported.

    At most rate / 2 of the names of any style and at that lower bound reach it, so that among what is
    reported at most about rate are names, if as many secrets as names are looked at and over half of the
    secrets reach it; nor does it go below what all but a share miss of random strings of every alphabet
    reach. Names and strings are made by rule, MADE of each, whatever the corpus.
    """
    return dict(zip(LENGTHS, _least_values(spark, rate, miss), strict=True))


def scan_secrets(docs: DataFrame, rate: float = 0.05, miss: float = 0.01) -> DataFrame:
    """Spans of secrets in every text: doc_id and spans.

    spans holds kind, start, end (code points, end exclusive) and base, by start, then kind as in
    KINDS; those of the fixed patterns have base true and always stay, the tests add tokens (kind
    random) that meet no base span, hold no keyword and reach the value that least_values gives for their
    length at rate and miss. A text's spans depend on nothing but the text. Null and empty texts have
    none; equal tokens are decided alike; repeated rows count each for itself; other columns are ignored;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    fixed = {"assign": f"filter({matches('text', ASSIGN, 2)}, m -> length(m.found) >= 6)", "access": matches("text", ACCESS), "hex": matches("text", HEX)}
    least = "case " + " ".join(f"when length(m.found) >= {n} then {p!r}D" for n, p in sorted(least_values(docs.sparkSession, rate, miss).items(), reverse=True)) + " end"
    token = f"not (m.found rlike '(?i){KEYWORD}' or m.found rlike '{ACCESS}' or m.found rlike '{HEX}')"
    found = fixed | {"random": f"filter({matches('text', EITHER)}, m -> {token} and {token_p_value('m.found')} >= {least})"}
    ordered = [f"transform({found[k]}, s -> named_struct('start', s.start, 'rank', {i}, 'kind', '{k}', 'end', s.end))" for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.expr(f"transform(sort_array(concat({', '.join(ordered)})), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'base', s.rank < 3))").alias("spans"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]),
        F.expr(f"sha2({joined.format('filter(spans, s -> s.base)')}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
