"""Toxicity of texts whose words may be disguised.

1. A character language model: counts of three characters in a row over all
   documents, added up in every task first. Characters are all letters of
   Unicode and one class for everything between words. The table grows with the
   letters of the corpus and stays in the shared folder; workers get what is
   in Latin-1, and of the rest the ``MOST_GRAMS`` commonest pairs and threes.
   A rarer three is judged by its pair, a rarer pair by its last letter.
2. A noisy channel: a disguised word (digits and signs for letters, signs
   between letters, three or more spaced letters, a letter repeated) is a lattice
   of readings of its characters; Viterbi decoding under the language model
   restores the likeliest word. At least one character must be a letter; more
   than eight signs and blanks in a row end a spaced word.
3. A classifier on the restored text: words and beginnings of words weighted by
   the log odds of toxic and other labelled texts, less two standard errors; a
   logistic curve turns the best weight and the number of hits into a score.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, those with the
smallest hashes of their ids, exact copies counted once. The language model
reads every text and no label.

Defined cases: null and empty texts get the score of a text without hits; texts
are read whole; rows are handled one by one, so repeated rows and null ids each
get their row (a null id is never held out nor learned from); labels that are
null are ignored, of several for one id the largest counts; without labels of
both kinds every score is the share of toxic ones, 0 if there are none; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.session import written

FIT_ROWS = 12_000
FOLDS = 5
LEAST_TEXTS = 4  # toxic ones must have a feature, however many there are
LEAST_WEIGHT = 1.5
RIDGE = 2.0
MOST_FEATURES = 3_000
BEGINNINGS = (4, 5, 6)
MOST_GRAMS = 500_000

LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c == c.lower())
BETWEEN = 0  # class of everything that is no letter
N = len(LETTERS) + 1  # classes of the letters above; any other has its code point and N
CLASS_OF = {c: i + 1 for i, c in enumerate(LETTERS)}
TO_CLASS = bytes(CLASS_OF.get(chr(b), BETWEEN) for b in range(256))

# What signs stand for, and costs of the channel (logarithms of how likely a step is).
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
            "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
            "(": "c", "£": "l", "§": "s", "*": "aeiou"}
AS_SIGN, DROP_SIGN, DROP_REPEAT, KEEP_REPEAT, NEW_WORD = -0.5, -6.0, -0.1, -1.5, -3.0

WORD = re.compile(r"[^\W\d_]+")
STANDS = re.escape("".join(c for c in READINGS if not c.isdigit()))  # signs that stand for letters
# One letter or digit after another, each maybe repeated; signs may stand for some of them.
ALONE = rf"[{STANDS}]|(?<![^\W_])([^\W_])\%d*+(?![^\W_])"
SPACED = re.compile(rf"(?<![^\W_])(?:{ALONE % 1})(?:(?:(?![{STANDS}])[\W_]){{0,8}}+(?:{ALONE % 2}))++")
DOUBLE = re.compile(r"([^\W\d_])\1")
TAIL = re.compile(r"(?:([^\w\s])\1+|[.,;:!?\"')\]])+$")
HEAD = re.compile(r"^[\"'(\[*_#]+")
PLAIN = ".,;:?\"')]}[{#_-"  # at the ends of a word never a letter
SINGLE = re.compile(r"([^\W_]+)")


# --- language model ---------------------------------------------------------

def class_of(c: str) -> int | None:
    """Class of a lower-case letter, None for anything else."""
    return CLASS_OF.get(c) or (N + ord(c) if c.isalpha() else None)


def letter_of(k: int) -> str:
    return chr(k - N) if k >= N else LETTERS[k - 1] if k else " "


def packed(a, b, c):
    """Three classes, of 21 bits each, as one number."""
    return (a << 42) | (b << 21) | c


@dataclass
class LanguageModel:
    """log p(c | a, b) of any classes, by ``model[a, b, c]``.

    ``base`` has those of Latin-1; ``threes`` and ``pairs`` are (sorted keys,
    counts), ``ones`` has the counts of all letters.
    """

    base: np.ndarray
    threes: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    ones: dict[int, int]

    def __post_init__(self):
        self.total, self.known = sum(self.ones.values()), {}
        self.letters = N + sum(k >= N for k in self.ones)

    def __getitem__(self, abc: tuple[int, int, int]) -> float:
        value = self.known.get(abc)
        if value is None:
            value = float(self.base[abc]) if max(abc) < N else self._log(*abc)
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[abc] = value
        return value

    def _log(self, a: int, b: int, c: int) -> float:
        p1 = (self.ones.get(c, 0) + 1) / (self.total + self.letters)
        p2 = (_count(self.pairs, packed(0, b, c)) + 2 * p1) / (self.ones.get(b, 0) + 2)
        return math.log((_count(self.threes, packed(a, b, c)) + 5 * p2)
                        / (_count(self.pairs, packed(0, a, b)) + 5))


def _count(grams: tuple[np.ndarray, np.ndarray], key: int) -> int:
    keys, counts = grams
    i = int(np.searchsorted(keys, key))
    return int(counts[i]) if i < len(keys) and keys[i] == key else 0


def count_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(at, n): counts over all texts, kept as a table; ``at`` packs three classes."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N ** 3, np.int64)
        for batch in batches:
            for joined in _joined(batch["t"]):
                total += _joined_counts(joined)
                if not _is_latin(joined):
                    for at, n in _other_counts(joined):
                        yield pd.DataFrame({"at": at, "n": n})
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": packed(at // N ** 2, at // N % N, at % N), "n": total[at]})

    return written(docs.select(F.col(text).alias("t")).mapInPandas(count, "at long, n long")
                   .groupBy("at").agg(F.sum("n").alias("n")), "trigrams")


def _commonest(grams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of at most ``most`` rows, those from some count up."""
    sizes = (grams.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("size"))
             .agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect())
    least, held = None, 0
    for r in sizes:  # a quarter of a power of two each
        held += r.rows
        if held > most:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = grams.where(F.floor(F.log2("n") * 4) >= least).toPandas().sort_values("at")
    return rows["at"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def language_model(grams: DataFrame, most: int = MOST_GRAMS) -> LanguageModel:
    """The model of (at, n), as small as workers need it."""
    def letter(k):
        return F.shiftright("at", 21 * k).bitwiseAND(F.lit((1 << 21) - 1))

    other = (letter(0) >= N) | (letter(1) >= N) | (letter(2) >= N)
    pairs = (grams.groupBy(F.col("at").bitwiseAND(F.lit((1 << 42) - 1)).alias("at"))
             .agg(F.sum("n").alias("n")))
    ones = {r.c: r.n for r in pairs.groupBy(letter(0).alias("c"))  # at most the letters there are
            .agg(F.sum("n").alias("n")).collect()}

    base = np.zeros(N ** 3, np.int64)
    latin = grams.where(~other).toPandas()
    at = latin["at"].to_numpy(np.int64)
    low = (1 << 21) - 1
    base[((at >> 42) * N + (at >> 21 & low)) * N + (at & low)] = latin["n"].to_numpy(np.int64)
    # every pair ends as many threes as it begins: texts begin and end with two blanks
    own = pairs.where((letter(0) < N) & (letter(1) < N)).toPandas()
    at, two = own["at"].to_numpy(np.int64), np.zeros((N, N))
    two[at >> 21, at & low] = own["n"].to_numpy(float)
    kept = _commonest(pairs.where(other), most)
    keys, counts = (np.concatenate([x, y]) for x, y in zip((at, own["n"].to_numpy(np.int64)), kept))
    order = np.argsort(keys)
    one = np.array([ones.get(c, 0) for c in range(N)], float)
    margins = two, one, sum(ones.values()), N + sum(k >= N for k in ones)
    return LanguageModel(log_model(base, margins), _commonest(grams.where(other), most),
                         (keys[order], counts[order]), ones)


def _joined(texts: Iterable[str | None]) -> Iterator[str]:
    """Lower-case texts parted by two spaces, some megabytes at a time."""
    held, size = [], 0
    for text in texts:
        if text:
            held.append(text)
            size += len(text)
            if size > 4_000_000:
                yield f"  {'  '.join(held).lower()}  "
                held, size = [], 0
    if held:
        yield f"  {'  '.join(held).lower()}  "


def batch_counts(texts: Iterable[str | None]) -> np.ndarray:
    """Counts of the threes of Latin-1 in a batch."""
    return sum(map(_joined_counts, _joined(texts)), np.zeros(N ** 3, np.int64))


def _is_latin(joined: str) -> bool:
    return joined.isascii() or max(joined) <= "\xff"


def _classes(joined: str) -> Iterator[np.ndarray]:
    """Classes of the characters in pieces that share two characters."""
    small = np.frombuffer(TO_CLASS, np.uint8).astype(np.int32)
    for start in range(0, len(joined) - 2, 1_000_000):
        piece = joined[start:start + 1_000_002].encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(piece, np.uint32)
        out, wide = small[np.minimum(c, 255)], c > 255
        found, at = np.unique(c[wide], return_inverse=True)
        out[wide] = np.array([class_of(chr(k)) or BETWEEN for k in found], np.int32)[at]
        yield out


def _joined_counts(joined: str) -> np.ndarray:
    if _is_latin(joined):
        c = np.frombuffer(joined.encode("latin-1").translate(TO_CLASS), np.uint8).astype(np.int32)
        return np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N ** 3)
    total = np.zeros(N ** 3, np.int64)
    for c in _classes(joined):
        own = c < N
        own = own[:-2] & own[1:-1] & own[2:]
        total += np.bincount((c[:-2][own] * N + c[1:-1][own]) * N + c[2:][own], minlength=N ** 3)
    return total


def _other_counts(joined: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of the threes with a letter beyond Latin-1, piece by piece."""
    for c in _classes(joined):
        other = c >= N
        other = other[:-2] | other[1:-1] | other[2:]
        a, b, c = (x[other].astype(np.int64) for x in (c[:-2], c[1:-1], c[2:]))
        yield np.unique(packed(a, b, c), return_counts=True)


def log_model(counts: np.ndarray, margins: tuple | None = None) -> np.ndarray:
    """log p(c | a, b) from three, two and one characters, mixed.

    ``margins``: counts of pairs and letters, their sum and the number of
    letters, where texts have more letters than these.
    """
    three = counts.reshape(N, N, N).astype(float)
    two, one, total, letters = margins or (three.sum(axis=0), three.sum(axis=(0, 1)),
                                           three.sum(), N)
    before, first = (two, one) if margins else (three.sum(axis=2), two.sum(axis=1))
    p1 = (one + 1) / (total + letters)
    p2 = (two + 2 * p1) / (first[:, None] + 2)
    p3 = (three + 5 * p2[None]) / (before[:, :, None] + 5)
    return np.log(p3).astype(np.float32)


# --- channel ----------------------------------------------------------------

def readings(chars: str) -> list[list[tuple[int | None, float]]]:
    """For every character the classes it may stand for, None for nothing at all."""
    out = []
    for i, c in enumerate(chars):
        options: list[tuple[int | None, float]] = []
        repeat = i > 0 and chars[i - 1] == c
        if c == " ":
            options += [(None, 0.0), (BETWEEN, NEW_WORD)]
        elif k := class_of(c):
            options.append((k, KEEP_REPEAT if repeat else 0.0))
            if repeat:
                options.append((None, DROP_REPEAT))
        else:
            options += [(CLASS_OF[x], AS_SIGN) for x in READINGS.get(c, "")]
            options.append((None, DROP_REPEAT if repeat else DROP_SIGN if c in READINGS else 0.0))
        out.append(options)
    return out


def decode(chars: str, model: np.ndarray | LanguageModel) -> str:
    """The likeliest words behind the characters, by Viterbi over the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BETWEEN, BETWEEN): (0.0, None)}
    for options in readings(chars):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for c, cost in options:
                if c is None:
                    state, value, way = (a, b), score + cost, path
                else:
                    state, value, way = (b, c), score + cost + float(model[a, b, c]), (path, c)
                if state not in after or value > after[state][0]:
                    after[state] = (value, way)
        states = after
    ends = ((score + float(model[a, b, BETWEEN]), way) for (a, b), (score, way) in states.items())
    _, path = max(ends, key=lambda end: end[0])
    letters = []
    while path:
        path, c = path
        letters.append(letter_of(c))
    return "".join(reversed(letters))


def disguised(text: str, words: set[str]) -> Iterator[str]:
    """Stretches of a lower-case text that look like a disguised word."""
    for token in text.split():
        if not token.isalpha():
            whole = token.strip(PLAIN)
            if not whole.isalpha() and any(map(class_of, whole)):
                bare = HEAD.sub("", TAIL.sub("", token))
                if not bare.isalpha():
                    yield bare
                if whole != bare:
                    yield whole  # signs at its ends may be letters, too
    for m in SPACED.finditer(text):
        yield from spaced(m[0])
    yield from filter(DOUBLE.search, words)


def spaced(run: str) -> set[str]:
    """A run of single letters without its signs, and with those that may be letters."""
    parts = SINGLE.split(run)
    letters, gaps = parts[1::2], ["".join(filter(READINGS.get, g)) for g in parts[::2]]
    if not any(class_of(c[0]) for c in letters):
        return set()
    often = Counter(c for g in gaps[1:-1] for c in set(g))
    between = {c for c, n in often.items() if n > 1 and 2 * n >= len(letters) - 1}
    found = {" ".join(letters)}
    for parting in ({*between}, set()) if any(gaps) else ():
        signs = [[c for c in g if c not in parting] for g in gaps]
        inner = [x for c, g in zip(letters, [*signs[1:-1], []]) for x in (c, *g)]
        found |= {" ".join(inner), " ".join([*signs[0], *inner, *signs[-1]])}
    return {x for x in found if x.count(" ") > 1}


class Restorer:
    """Words of a text and those behind disguised ones; remembers what it decoded.

    A full memory is kept beside a new one until that is full, too.
    """

    def __init__(self, model: np.ndarray | LanguageModel, remembered: int = 250_000):
        self.model, self.remembered, self.known, self.older = model, remembered, {}, {}

    def behind(self, chars: str) -> list[str]:
        found = self.known.get(chars)
        if found is None:
            found = self.older.get(chars)
            if found is None:
                found = decode(chars, self.model).split()
            if len(self.known) >= self.remembered:
                self.known, self.older = {}, self.known
            if len(chars) <= 100:
                self.known[chars] = found
        return found

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        words = set(WORD.findall(low))
        found = words.copy()
        for d in disguised(low, words):
            found.update(self.behind(d))
        return found


# --- classifier -------------------------------------------------------------

def features(words: Iterable[str]) -> set[str]:
    """Words, and beginnings of words marked by a hyphen."""
    out = set()
    for w in words:
        out.add(w)
        for n in BEGINNINGS:
            if len(w) >= n:
                out.add(w[:n] + "-")
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _signals(words: Iterable[str], weights: dict[str, float],
             starts: set[str]) -> tuple[float, float]:
    """The best weight and the logarithm of the number of words that have one.

    ``starts`` holds the first four characters of all features.
    """
    best, hits = 0.0, 0
    for w in words:
        if w[:4] in starts:
            found = max(weights.get(w, 0.0), *(weights.get(w[:n] + "-", 0.0)
                                               for n in BEGINNINGS if len(w) >= n), 0.0)
            if found:
                hits += 1
                best = max(best, found)
    return best, math.log1p(hits)


def starts_of(weights: dict[str, float]) -> set[str]:
    return {f[:4] for f in weights}


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and coefficients by Newton's method, coefficients held back by a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge,
                               x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass(frozen=True)
class Toxicity:
    """Language model, weights of features, coefficients of the curve."""

    model: LanguageModel
    weights: dict[str, float]
    beta: np.ndarray

    def score(self, restorer: Restorer, starts: set[str], text: str | None) -> float:
        best, hits = _signals(restorer.words(text), self.weights, starts)
        z = self.beta[0] + self.beta[1] * best + self.beta[2] * hits
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def _chosen(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """(t, toxic): texts to fit on, at most ``rows`` of them."""
    ids = (labels.where("toxic is not null and doc_id is not null")
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .where(~held_out(F.col("doc_id")))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return (texts.join(F.broadcast(ids), "doc_id").select("t", "toxic")
            .groupBy("t").agg(F.max("toxic").alias("toxic")))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        rows: int = FIT_ROWS) -> Toxicity:
    """``labels`` has (doc_id, toxic); rows that are held out are not used."""
    model = language_model(count_trigrams(docs, text))
    # bounded by ``rows``: words of the chosen texts, read twice
    chosen = _chosen(docs, labels, doc_id, text, rows)

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model)
        for batch in batches:
            yield pd.DataFrame({"words": [list(restorer.words(t)) for t in batch["t"]],
                                "toxic": batch["toxic"]})

    words = written(chosen.mapInPandas(restored, "words array<string>, toxic int"), "restored")
    n1, n = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return Toxicity(model, {}, np.array([_logit(n1 / n if n else 0.0), 0.0, 0.0]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter(), Counter()
        for batch in batches:
            for w, y in zip(batch["words"], batch["toxic"]):
                seen[y].update(features(w))
        yield pd.DataFrame([(f, seen[1][f], seen[0][f]) for f in seen[1]],
                           columns=["f", "n1", "n0"])
        yield pd.DataFrame([(f, 0, k) for f, k in seen[0].items() if f not in seen[1]],
                           columns=["f", "n1", "n0"])

    # two standard errors below the log odds: what a few texts show counts for little
    weight = (F.log((F.col("n1") + 0.5) / (n1 + 1.0))
              - F.log((F.col("n0") + 0.5) / (n - n1 + 1.0))
              - 2 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    best = (words.mapInPandas(count, "f string, n1 long, n0 long").groupBy("f")
            .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
            .where(F.col("n1") >= LEAST_TEXTS)
            .withColumn("w", weight).where(F.col("w") > LEAST_WEIGHT)
            .orderBy(F.desc(F.col("w") * F.sqrt("n1")), "f").limit(MOST_FEATURES).collect())
    weights = {r.f: r.w for r in best}

    @F.pandas_udf("best double, hits double")
    def signal(lists: pd.Series) -> pd.DataFrame:
        starts = starts_of(weights)
        return pd.DataFrame([_signals(w, weights, starts) for w in lists],
                            columns=["best", "hits"])

    data = words.select(signal("words").alias("s"), "toxic").select("s.*", "toxic").toPandas()
    beta = logistic(data[["best", "hits"]].to_numpy(float), data["toxic"].to_numpy(float))
    return Toxicity(model, weights, beta)


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def score_texts(docs: DataFrame, fitted: Toxicity, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer, starts = Restorer(fitted.model), starts_of(fitted.weights)
        for texts in batches:
            yield pd.Series([fitted.score(restorer, starts, t) for t in texts], dtype=float)

    return (docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                        score(F.col(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
