"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags the tokens of a text (what white space separates; long ones are cut where a class of
characters ends) with a kind or none, from features of the token's shape and of whether the words
before it announce a number of something (an order, an invoice). It is trained on the driver from a
small labelled table: runs of tokens around the patterns' spans in a sample of documents, and the same
runs with each span written in a form that the patterns miss (other separators, no country code,
masked marks, the newer addresses) or replaced by something that only looks alike. The features tell
the lengths of groups of digits from the marks between them, so that forms that were in no label are
found too. Its decoding is Viterbi's, in numpy over all runs of a batch at once. Tokens whose shape
scores so far below none that no neighbour can change it are settled beforehand; the best path is the
same without them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import given_back, table, text_batches

KINDS = ["email", "ip", "card", "phone"]
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
#: Tokens that a task's cache holds at most, and the longest that it takes in.
CACHED_TOKENS, CACHED_LENGTH = 100_000, 256
#: Longer tokens are cut where a class of characters ends.
LONG = 64

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"[A-Za-z0-9._%+@()\[\]{}:/-]+|[^A-Za-z0-9._%+@()\[\]{}:/-]+")
_LEFT, _RIGHT = re.compile(r"[^\w+(]+"), re.compile(r"[^\w)]+")
_MASKED = re.compile(r"[\w.%+-]+([(\[{<]at[)\]}>]|\uff20)[\w-]+((\.|[(\[{<]dot[)\]}>])[\w-]+)+", re.I)
_MASKED_DOT = re.compile(r"[(\[{<](?:\.|dot)[)\]}>]", re.I)
_SIX = re.compile(r"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}")
#: Words after which a number counts what they name, and words that may stand between.
NAMED = frozenset("order orders invoice ticket ref reference item part serial case isbn sku model batch lot article bestellung rechnung auftrag pedido factura commande facture".split())
BETWEEN = frozenset("no nr number num id code is nummer numero".split())
#: Ends the key of a token that stands after such words; no shape holds it.
AFTER = "\x7f"
#: Lengths of the groups of digits in telephone numbers without a plus.
PHONE_GROUPS = ((3, 3, 4), (1, 3, 3, 4), (4, 3, 4), (3, 4, 4))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as in KINDS, then start, in code points."""
    found, cursor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            cursor = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def margins(token: str) -> tuple[int, int]:
    """Lengths of the marks at either end of a token that do not belong to what it holds."""
    left = m.end() if (m := _LEFT.match(token)) else 0
    right = m.end() if left < len(token) and (m := _RIGHT.match(token[::-1])) else 0
    return left, right


def shape(token: str) -> str:
    """The shape of a token: letters as a or A, digits as 0, long runs shortened."""
    s = "".join("0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if c < "\x7f" else "?" for c in token)
    s = re.sub(r"a{2,}", "a+", re.sub(r"A{2,}", "A+", s))
    return re.sub(r"([^aA0+])\1{4,}", r"\1\1\1\1", re.sub(r"0{24,}", "0" * 24, s))


def is_six(core: str) -> bool:
    """Whether core is an address of eight groups, or of fewer with one gap; with digits, as names in programs have none."""
    return bool(_SIX.fullmatch(core) and _DIGIT.search(core)) and core.count("::") <= 1 and ":::" not in core and ("::" in core[1:-1] or core.count(":") == 7 and "" not in core.split(":"))


def token_key(token: str) -> str:
    """What the features of a token depend on: its shape, and whether what it holds passes the checks."""
    if token.isalpha():
        return "A" if token[0].isupper() else "a"
    left, right = margins(token)
    core, mark = token[left : len(token) - right], ""
    if 13 <= len(core) <= 27 and (d := re.sub(r"[\W_]", "", core)).isascii() and d.isdigit() and 13 <= len(d) <= 19:
        mark = "|luhn" if luhn(d) else "|not-luhn"
    elif (dotted := _MASKED_DOT.sub(".", core)).count(".") == 3 and (d := dotted.replace(".", "")).isascii() and d.isdigit():
        mark = "|octets" if all(dotted.split(".")) and octets(dotted) else "|not-octets"
    elif core.count(":") >= 2:
        if is_six(core):
            return "0:0|six"
        mark = "|not-six"
    elif _MASKED.fullmatch(core):
        return "a@a|masked"
    return (re.sub("0+", "0", shape(token)) if mark else shape(token)) + mark


def announced(words: list[str], i: int) -> bool:
    """Whether the words before the i-th say that it numbers an order or the like: one of NAMED, then up to two of BETWEEN, numbers or marks."""
    for j in range(i - 1, max(i - 4, -1), -1):
        word = words[j].strip(".,:;#()[]\"'").lower()
        if word in NAMED:
            return True
        if word not in BETWEEN and any(c.isalpha() for c in word):
            return False
    return False


def token_keys(words: list[str]) -> list[str]:
    """The keys of a text's tokens; that of a token with digits tells whether it is announced."""
    return [token_key(w) + (AFTER if _DIGIT.search(w) and announced(words, i) else "") for i, w in enumerate(words)]


def key_features(key: str, columns: int) -> np.ndarray:
    """Hashed feature columns of a token key."""
    after = key.endswith(AFTER)
    s, _, mark = key.removesuffix(AFTER).partition("|")
    left, right = margins(s)
    core = s[left : len(s) - right]
    digits, other = s.count("0"), "".join(sorted(set(re.sub(r"[aA0+]", "", core))))
    bucket = int(np.searchsorted([1, 2, 4, 7, 9, 13, 17, 20], digits, side="right"))
    plain = not mark and digits >= 7 and not re.search("[aA]", core)  # numbers are told by their groups and marks alone
    names = ["bias", *([] if plain else [f"shape={s}", f"core={core}"]), f"mark={mark}", f"digits={bucket}", f"other={other}", f"at={'@' in core}{core.count('.')}",
             f"plus={core[:1] == '+'}{bucket}", f"paren={core[:1] == '('}{core[-1:] == ')'}{bucket}", f"letters={'a' in core or 'A' in core}{bucket}", f"mark-digits={mark}{bucket}"]
    if not mark and digits:
        names.append(f"groups={'-'.join(str(len(x)) for x in re.findall('0+', core))}{'a' in core or 'A' in core}")
    if after:
        names.append(f"after={mark}{bucket}")
    return np.array(sorted({crc32(n.encode()) % columns for n in names}), np.int64)


@dataclass
class ChainModel:
    """weights: a row per feature column, a column per tag, none first; moves: from tag, to tag."""

    weights: np.ndarray
    moves: np.ndarray
    keys: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def key_id(self, key: str) -> int:
        if key not in self.keys:
            self.keys[key] = len(self.rows)
            self.rows.append(self.weights[key_features(key, len(self.weights))].sum(axis=0))
        return self.keys[key]

    def slack(self) -> float:
        """What the moves around a token can give another tag over none at most."""
        m = self.moves
        return float((m[:, :, None] + m[None, :, :] - m[:, :1, None] - m[None, :1, :]).max())


def _forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray, heavy: np.ndarray):
    """Tag expectations of padded sequences, none standing before and after each, and weighted ones of moves."""
    n, length, tags = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[:, 0] = moves[0] + scores[:, 0]
    for t in range(1, length):
        x = alpha[:, t - 1, :, None] + moves
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + scores[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    last = mask.sum(axis=1) - 1
    end = alpha[np.arange(n), last] + moves[:, 0]
    top = end.max(axis=1)
    z = top + np.log(np.exp(end - top[:, None]).sum(axis=1))
    beta[:, length - 1] = moves[:, 0]
    for t in range(length - 2, -1, -1):
        x = (beta[:, t + 1] + scores[:, t + 1])[:, None, :] + moves
        top = x.max(axis=2)
        new = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
        beta[:, t] = np.where(mask[:, t + 1, None], new, moves[:, 0])
    tag = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    both = np.zeros((tags, tags))
    both[0] += heavy @ tag[:, 0]
    both[:, 0] += heavy @ tag[np.arange(n), last]
    for t in range(1, length):
        x = alpha[:, t - 1, :, None] + moves + (beta[:, t] + scores[:, t])[:, None, :] - z[:, None, None]
        both += np.einsum("nij,n->ij", np.exp(np.minimum(x, 0)), heavy * mask[:, t])
    return tag, both


def train_chain(sequences: list[list[tuple[str, int]]], weights: list[float] | None = None, columns: int = 1 << 12, rounds: int = 80, l2: float = 1e-3, rate: float = 0.3) -> ChainModel:
    """Fits the field by gradient ascent on its log likelihood; sequences hold (token key, tag)."""
    heavy = np.ones(len(sequences)) if weights is None else np.asarray(weights, float)
    tags = len(KINDS) + 1
    model = ChainModel(np.zeros((columns, tags)), np.zeros((tags, tags)))
    if not any(tag for s in sequences for _, tag in s):
        model.weights[crc32(b"bias") % columns, 0] = 100.0  # nothing to learn from: none everywhere
        return model
    keys = sorted({k for s in sequences for k, _ in s})
    at = {k: i for i, k in enumerate(keys)}
    used = np.zeros((len(keys), columns), np.float32)
    for k, i in at.items():
        used[i, key_features(k, columns)] = 1
    live = np.flatnonzero(used.any(axis=0))
    used = used[:, live].astype(np.float64)
    n, length = len(sequences), max(map(len, sequences))
    ids, gold, mask = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for r, s in enumerate(sequences):
        ids[r, : len(s)], gold[r, : len(s)], mask[r, : len(s)] = [at[k] for k, _ in s], [t for _, t in s], True
    seen = np.zeros((len(keys), tags))
    each = np.broadcast_to(heavy[:, None], mask.shape)[mask]
    np.add.at(seen, (ids[mask], gold[mask]), each)
    moved, n = np.zeros((tags, tags)), heavy.sum()
    for r in range(len(sequences)):
        path = [0, *gold[r, mask[r]], 0]
        np.add.at(moved, (path[:-1], path[1:]), heavy[r])
    w, moves = np.zeros((len(live), tags)), np.zeros((tags, tags))
    sw, sm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    parts = [(p, mask[p].sum(axis=1).max()) for p in np.array_split(np.argsort(mask.sum(axis=1), kind="stable"), min(8, len(mask)))]  # of like lengths
    parts = [(ids[p, :most], mask[p, :most], heavy[p]) for p, most in parts]
    for _ in range(rounds):
        scores, expected, both = used @ w, np.zeros_like(seen), np.zeros((tags, tags))
        for at_, there, weight in parts:
            tag, pairs = _forward_backward(scores[at_], there, moves, weight)
            both += pairs
            np.add.at(expected, at_[there], tag[there] * np.repeat(weight, there.sum(axis=1))[:, None])
        gw, gm = used.T @ (seen - expected) / n - l2 * w, (moved - both) / n - l2 * moves
        sw, sm = sw + gw**2, sm + gm**2
        w, moves = w + rate * gw / np.sqrt(sw), moves + rate * gm / np.sqrt(sm)
    model.weights[live], model.moves = w, moves
    return model


def forms(kind: str, found: str, n: list[int]) -> dict[str, list[str]]:
    """The tokens of a span's forms that the patterns miss, by name; n are random numbers below 65536."""
    if kind == "email":
        name, _, host = found.partition("@")
        at = {"round": ("(at)", "(dot)"), "square": ("[at]", "[dot]"), "curly": ("{at}", "{dot}"), "angle": ("<at>", "<dot>"), "wide": ("\uff20", ".")}
        return {f"email {k}": [name + a + (host.replace(".", d) if n[0] % 2 else host)] for k, (a, d) in at.items()}
    if kind == "ip":
        g = [format(x, "x") for x in n]
        g[0] = f"{n[0] % 10}{g[0][:3]}"
        masked = {"square": "[.]", "round": "(.)", "word": "[dot]"}
        return {f"ip {k}": [found.replace(".", d)] for k, d in masked.items()} | {"ip eight": [":".join(g[:8])], "ip gap": [f"{g[0]}::{g[1]}"], "ip gaps": [f"{g[0]}:{g[1]}::{g[2]}:{g[3]}"]}
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        marks = {"dot": ".", "slash": "/", "underscore": "_", "dash": "\u2013", "tie": "\xa0"}
        return {f"card {k}": [m.join(digits[i : i + 4] for i in range(0, len(digits), 4))] for k, m in marks.items()}
    out = {}
    d = (digits + "".join(f"{x:05d}" for x in n[:3]))[-15:] if len(digits) < 11 else digits
    for groups in PHONE_GROUPS:
        last, parts = len(d), []
        for size in groups[::-1]:
            parts, last = [d[last - size : last], *parts], last - size
        name = "".join(map(str, groups))
        out |= {f"phone {name} {k}": [m.join(parts)] for k, m in {"dash": "-", "dot": ".", "slash": "/", "long dash": "\u2013"}.items()}
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return out | {"phone paren": [f"({a})", f"{b}-{c}"], "phone tight paren": [f"({a}){b}-{c}"], "phone paren dot": [f"({a})", f"{b}.{c}"], "phone mixed": [f"{a}/{b}-{c}"], "phone zeros": [f"00{d[:-10] or '1'}-{a}-{b}-{c}"]}


def look_alikes(kind: str, found: str, n: list[int], h: str) -> list[list[str]]:
    """Tokens that only look like personal data; n are random numbers below 65536, h 32 hexadecimal digits."""
    fails = f"{n[0] % 10000:04d}{n[1] % 10000:04d}{n[2] % 10000:04d}{n[3] % 1000:03d}"
    fails += next(str(d) for d in range(10) if not luhn(fails + str(d)))
    mark, year, word = "._/"[n[5] % 3], 1950 + n[0] % 90, "abcdefghijklmnop"
    names = ["".join(word[x >> k & 15] for k in range(0, 4 * (1 + x % 3), 4)) for x in n[:4]]
    cuts, left = [], 7 + n[4] % 9
    while left > 0:
        cuts.append(min(left, 1 + n[len(cuts) % 7] // (3 + len(cuts)) % 5))
        left -= cuts[-1]
    if tuple(cuts) in PHONE_GROUPS or len(cuts) < 2:
        cuts = [3, 2, 4]
    numbers = [str(10 ** (k - 1) + n[i % 8] % (9 * 10 ** (k - 1))) for i, k in enumerate(cuts)]
    out = [
        f"{year}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}", f"{1 + n[1] % 28}.{1 + n[2] % 12}.{year}", f"{n[0] % 24:02d}:{n[1] % 60:02d}:{n[2] % 60:02d}", f"{n[0] % 900 + 1},{n[1] % 1000:03d}.{n[2] % 100:02d}",
        f"{n[0] % 20}.{n[1] % 30}.{n[2] % 9}", f"v{n[0] % 9}.{n[1] % 20}", mark.join(fails[k : k + 4] for k in range(0, 16, 4)), ":".join(h[k : k + 2] for k in range(0, 12, 2)), f"{n[0] % 900 + 100}-{n[1] % 9000 + 1000}",
        f"{h[:8]}-{h[8:12]}-{h[12:16]}", f"{300 + n[0] % 600}[.]{300 + n[1] % 600}[.]{n[2] % 900}[.]{300 + n[3] % 600}", f"look(s)at({h[:3]})",
        f"{n[0] % 900 + 100}{'-./'[n[6] % 3]}{n[1] % 90 + 10}{'-./'[n[6] % 3]}{n[2] % 9000 + 1000}", f"{year}/{year + 1}-{year + 2 + n[1] % 9}", f"{year}{'-/'[n[1] % 2]}{year + 1 + n[2] % 20}", f"{1 + n[1] % 12:02d}/{year}-{1 + n[2] % 12:02d}/{year + 1}",
        "::".join(names[: 2 + n[5] % 3]), f"{n[0] % 90000 + 10000}-{n[1] % 9000 + 1000}", ("-", ".", "/", "\u2013", "_")[n[7] % 5].join(numbers), "-".join(numbers),
    ]
    found_forms = [[x] for x in out]
    if kind == "phone":
        named, tails = sorted(NAMED), [[], ["no."], ["number"], ["#"]]
        usual = sorted(forms(kind, found, n).items())
        found_forms += [[named[n[k] % len(named)] + ("s:" if n[k + 1] % 5 == 0 else ""), *tails[n[k + 2] % 4], *usual[n[k + 3] % len(usual)][1]] for k in range(4)]
    return found_forms


def rewritten(kind: str, found: str, salt: int, without: frozenset[str] = frozenset()) -> list[tuple[str, str | None]]:
    """Tokens, each with its kind or None, to stand for a span: a form that the patterns miss, or a look-alike.

    Which one is taken, and its digits, come from a hash of the span and salt. without names forms not to take.
    """
    h = md5(f"{salt}:{found}".encode("utf-8", "surrogatepass")).hexdigest()
    n = [int(h[k : k + 4], 16) for k in range(0, 32, 4)]
    if salt % 2:
        likes = look_alikes(kind, found, n, h)
        return [(t, None) for t in likes[(n[6] * 31 + n[3]) % len(likes)]]
    usual = [x for name, x in forms(kind, found, n).items() if name not in without]
    return [(t, kind) for t in usual[(n[6] * 31 + n[3]) % len(usual)]]


def labelled_windows(text: str, spans: list[tuple[str, int, int]], reach: int = 5, times: int = 16, without: frozenset[str] = frozenset()) -> list[list[tuple[str, int]]]:
    """Runs of tokens around those with digits or marks, with tags from labelled spans; then those with spans rewritten, a few times."""
    tokens = _places(text)
    words = [text[a:b] for a, b in tokens]
    owner = [next((k for k, (_, a, b) in enumerate(spans) if a < end and start < b), -1) for start, end in tokens] if spans else [-1] * len(tokens)
    near = sorted({j for i, t in enumerate(words) if i % 200 == 100 or "@" in t or _DIGIT.search(t) for j in range(max(0, i - reach), min(len(tokens), i + reach + 1))})
    runs: list[list[int]] = []
    for k, j in enumerate(near):
        if not k or near[k - 1] != j - 1 or len(runs[-1]) >= 40:
            runs.append([])
        runs[-1].append(j)
    keys = token_keys(words)
    out = [[(keys[j], KINDS.index(spans[owner[j]][0]) + 1 if owner[j] >= 0 else 0) for j in run] for run in runs]
    for run in runs:
        for salt in range(times) if any(owner[j] >= 0 for j in run) else ():
            new: list[tuple[str, str | None]] = []
            for k, j in enumerate(run):
                if owner[j] < 0:
                    new.append((words[j], None))
                elif not k or owner[run[k - 1]] != owner[j]:
                    kind, a, b = spans[owner[j]]
                    new += rewritten(kind, text[a:b], salt, without)
            out.append([(key, KINDS.index(tag) + 1 if tag else 0) for key, (_, tag) in zip(token_keys([t for t, _ in new]), new, strict=True)])
    return out


def train_from_documents(docs: DataFrame, max_rows: int = 4000, max_runs: int = 2000, without: frozenset[str] = frozenset()) -> ChainModel:
    """Trains on a labelled table from at most about max_rows documents, taken evenly by a hash of doc_id.

    The table holds labelled_windows of the fixed patterns' spans. Equal runs are one, with the logarithm
    of their number in its weight; at most max_runs different ones count, taken evenly by a hash, half
    of them with spans if there are so many. without names forms to leave out of the labels, to see
    how far the field reaches beyond its labels.
    """
    n = docs.count()
    parts = 1 << 24
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(np.ceil(parts * min(1.0, max_rows / max(n, 1))))).where("text is not null")

    def runs(batches):
        for whole in batches:
            for batch in text_batches(whole):
                got = [r for t in batch.column(0).to_pylist() for r in labelled_windows(t, base_spans(t), without=without)]
                yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in r] for r in got], pa.list_(pa.string())), pa.array([[t for _, t in r] for r in got], pa.list_(pa.int32()))], ["keys", "tags"])

    rows = some.select(F.col("text").cast("string").alias("text")).mapInArrow(given_back(runs), "keys array<string>, tags array<int>")
    rows = rows.groupBy("keys", "tags").agg(F.count("*").alias("k")).withColumn("any", F.exists("tags", lambda t: t > 0))
    rank = F.row_number().over(Window.partitionBy("any").orderBy(F.xxhash64("keys", "tags")))  # of a bounded number of runs
    rows = rows.withColumn("rank", rank).orderBy("rank", "any").limit(max_runs).collect()
    return train_chain([list(zip(r["keys"], r["tags"], strict=True)) for r in rows], [1 + np.log(r["k"]) for r in rows])


def viterbi(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best tags of each run, none standing before and after it; ties go to the earlier tag."""
    out: list[np.ndarray | None] = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    for lo in range(0, len(order), 1024):
        part = order[lo : lo + 1024]
        sizes = np.array([len(scores[i]) for i in part])
        padded = np.zeros((len(part), sizes.max(), len(moves)))
        for r, i in enumerate(part):
            padded[r, : sizes[r]] = scores[i]
        best, back = moves[0] + padded[:, 0], np.zeros(padded.shape, np.int8)
        final = best.copy()
        for t in range(1, padded.shape[1]):
            x = best[:, :, None] + moves
            back[:, t] = x.argmax(axis=1)
            best = x.max(axis=1) + padded[:, t]
            final = np.where((sizes > t)[:, None], best, final)
        tag = (final + moves[:, 0]).argmax(axis=1)
        path = np.zeros(padded.shape[:2], np.int8)
        for t in range(padded.shape[1] - 1, -1, -1):
            inside = sizes > t
            path[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, back[np.arange(len(part)), t, tag], tag)
        for r, i in enumerate(part):
            out[i] = path[r, : sizes[r]]
    return out


class Tagger:
    """Finds the spans of texts with the fixed patterns and a trained field."""

    def __init__(self, model: ChainModel):
        self.model, self.least = model, model.slack()
        self.ids: dict[str, int] = {}  # of tokens; -1 for settled ones

    def token_id(self, token: str) -> int:
        key = token_key(token)
        k = self.model.key_id(key)
        both = [self.model.rows[k], self.model.rows[self.model.key_id(key + AFTER)]]
        k = -1 if all(s[0] - s[1:].max() > self.least for s in both) else k
        if len(token) <= CACHED_LENGTH:
            self.ids[token] = k
        return k

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        if len(self.ids) >= CACHED_TOKENS or len(self.model.keys) >= CACHED_TOKENS:
            self.ids.clear()
            self.model.keys.clear()
            self.model.rows.clear()
        runs, scores = [], []
        for d, text in enumerate(texts):
            get = self.ids.get
            tokens = _split(text)
            ids = [k if (k := get(t)) is not None else self.token_id(t) for t in tokens]
            at = np.flatnonzero(np.array(ids, np.int64) >= 0)
            for i in at:
                if _DIGIT.search(tokens[i]) and announced(tokens, i):
                    ids[i] = self.model.key_id(token_key(tokens[i]) + AFTER)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                runs.append((d, run))
                scores.append(np.array([self.model.rows[ids[i]] for i in run]))
        tagged: dict[int, list[tuple[int, int]]] = {}
        for (d, run), tags in zip(runs, viterbi(scores, self.model.moves), strict=True):
            tagged.setdefault(d, []).extend((int(i), int(t)) for i, t in zip(run, tags, strict=True) if t)
        out = []
        for d, text in enumerate(texts):
            base = base_spans(text)
            more = self.added(text, tagged[d], base) if tagged.get(d) else []
            spans = [(*s, True) for s in base] + [(*s, False) for s in more]
            out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])) if more else spans)
        return out

    def added(self, text: str, tags: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The spans of tagged tokens that meet none of base; tokens of one phone number, of 7 to 15 digits, are one."""
        places, out, last = _places(text), [], (-2, 0)
        for i, tag in tags:
            start, end = places[i]
            left, right = margins(text[start:end])
            start, end, kind = start + left, end - right, KINDS[tag - 1]
            if kind == "phone" and last == (i - 1, tag) and out:
                out[-1] = (kind, out[-1][1], end)
            elif start < end:
                out.append((kind, start, end))
            last = (i, tag)
        taken, kept, k, reach = sorted((a, b) for _, a, b in base), [], 0, -1
        for s in sorted(out, key=lambda s: s[1]):
            if s[0] == "phone" and not 7 <= len(_DIGIT.findall(text, s[1], s[2])) <= 15:
                continue
            while k < len(taken) and taken[k][0] < s[2]:
                reach, k = max(reach, taken[k][1]), k + 1
            if reach <= s[1]:
                kept.append(s)
        return kept


_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _split(text: str) -> list[str]:
    """The tokens of a text."""
    tokens = _TOKEN.findall(text) if _ODD_SPACE.search(text) else text.split()
    if tokens and max(map(len, tokens)) > LONG:
        return [p for t in tokens for p in ([t] if len(t) <= LONG else _PIECE.findall(t))]
    return tokens


def _places(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text begin and end."""
    found = [m.span() for m in _TOKEN.finditer(text)]
    return [p for a, b in found for p in ([(a, b)] if b - a <= LONG else [m.span() for m in _PIECE.finditer(text, a, b)])]


def redact(text: str | None, spans: list[tuple]) -> str | None:
    """text with each span replaced by its kind in brackets; a span that begins in another adds to it."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _find(model, with_text: bool, clean: bool):
    def run(batches):
        tagger = Tagger(model.value)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for whole in batches:
            for batch in text_batches(whole):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = tagger.spans([t or "" for t in texts])
                spans = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found], pa.list_(kind))
                columns, names = batch.columns[:-1], batch.schema.names[:-1]
                if with_text:
                    columns, names = [*columns, pa.array(map(redact, texts, found), pa.string()) if clean else batch.columns[-1]], [*names, "text"]
                yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "spans"])

    return run


def find_personal_data(docs: DataFrame, model: ChainModel, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, clean: bool = False) -> DataFrame:
    """Spans of personal data in every text: the columns in keep, (text,) and spans.

    spans holds kind, start, end (code points, end exclusive) and base (of the fixed patterns, which
    always stay), by kind as in KINDS, then start. Spans that the model adds never overlap those. With
    clean, text holds each span's kind in brackets in its place. Null and empty texts have none; repeated
    rows count each for itself; other columns are ignored; an empty table gives an empty result. keep
    must not name text or spans.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep) + with_text])
    return rows.mapInArrow(given_back(_find(docs.sparkSession.sparkContext.broadcast(model), with_text, clean)), f"{schema}, spans {SPANS}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train_from_documents(docs))
    count = {f"n_{k}": F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)") for k in KINDS}
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select("doc_id", *(c.alias(k) for k, c in count.items()), F.expr(f"sha2({joined.format('filter(spans, s -> s.base)')}, 256)").alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
