"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

A text is folded first: letters that look like others (Cyrillic, Greek, full-width, mathematical) and digits or signs that stand for
letters become those letters, marks and invisible characters go, and all that is no letter or digit becomes a space.  As a 1 may stand for an i or an l,
these two are one letter.  Terms are beginnings of words; the automaton finds, from left to right, the longest pattern at
each place.  Exception phrases are longer patterns without weight (a whole word that goes on after a term, or a term's word with
its neighbour), so a term inside one isn't counted.  The score is a logistic function of the summed weights,
of the same over the text's length, and of the number of different terms.

A lexicon can be given by hand or learnt (``fit``) from at most ``TRAIN_ROWS`` labelled rows outside the held-out fold, those with the least hash of the
id; equal texts count once.  Spark counts in how many of these rows of either label each beginning of a word is met; a term's weight is the lower
end of the interval of its log odds, so what is rare weighs little, and it is kept only where a longer one doesn't explain it and where it is
among the weightiest of enough toxic rows.  At most ``TERMS`` patterns,
those with the greatest weights, are fetched.  Everything after that covers all rows: each text is read whole and once, nothing is shuffled.

Defined results: null and empty texts have no hits and get the score of a text without any, as do texts in which nothing is a word; without labelled rows of both
kinds the lexicon is empty and every score is the share of toxic rows, (toxic + 1/2) / (rows + 2); repeated rows are scored each; rows that
label an id in two ways are learnt from in both; a null id is in no fold, so it is not held out and never learnt from.  A text is folded as one string, which takes up
to eight bytes for each of its characters.  Only the id and text columns are read, so other columns don't matter.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.llm._spark import discard, release, written

TRAIN_ROWS = 20_000
TERMS = 5_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Letters of a term, and rows of the label in question that a pattern must occur in.
SHORTEST, LONGEST, LEAST_ROWS = 3, 12, 3
#: Width of the intervals in standard deviations, and the least weight of a term.
WIDTH, LEAST_WEIGHT = 1.5, 1.0
#: A text's terms beyond so many of greatest weight don't count for it: what else copies of a toxic text share isn't toxic.
LEADING = 3
#: Patterns that a task counts before it passes them on.
AT_ONCE = 500_000
SCORES = "doc_id long, held_out boolean, score double, predicted int, hits long, weight double"
COUNTS = "pattern string, toxic long, clean long"

# Letters that look like a Latin one, and what digits and signs stand for.
LOOKS = dict(zip("аеорсухіјѕһԁԛԝкмтвнαεικνορτυχωıɑɡøłđ", "aeopcyxijshdqwkmtbhaeikvoptuxwiagold", strict=True))
STANDS = dict(zip("013457@$", "oieastas", strict=True))


class Folding(dict):
    """What each code point becomes, found by rule when first met."""

    def __missing__(self, point: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(point)).lower():
            c = STANDS.get(c) or LOOKS.get(c, c)
            kind = unicodedata.category(c)
            out += "i" if c == "l" else c if kind[0] in "LN" else "" if kind in ("Mn", "Me", "Cf") else " "
        self[point] = out
        return out


_FOLDING = Folding()


def fold(text: str | None) -> str:
    """A space, and the folded text; words are what spaces part."""
    return " " + (text or "").translate(_FOLDING)


@dataclass
class Lexicon:
    """Weights of patterns (each a space and the beginning of a word or phrase; no weight: an exception), and the logistic layer."""

    weights: dict[str, float] = field(default_factory=dict)
    layer: tuple[float, float, float, float] = (-3.0, 1.0, 0.5, 0.5)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, terms: dict[str, float], exceptions: list[str] = (), **more) -> Lexicon:
        """From terms and phrases as they are written."""
        patterns = {" " + " ".join(fold(t).split()): w for t, w in terms.items()}
        return cls(patterns | {" " + " ".join(fold(e).split()): 0.0 for e in exceptions}, **more)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.layer, self.automaton = np.array(lexicon.layer), ahocorasick.Automaton()
        for pattern, weight in lexicon.weights.items():
            self.automaton.add_word(pattern, (pattern, weight))
        self.automaton.make_automaton()
        self.any = bool(lexicon.weights)

    def hits(self, folded: str) -> Iterator[tuple[int, str, float]]:
        """(place of the last letter, pattern, weight) of the longest pattern at each place, from left to right, none overlapping another."""
        if not self.any:
            return
        longest: dict[int, tuple[int, str, float]] = {}
        for at, (pattern, weight) in self.automaton.iter(folded):
            # of one place's patterns the longest is found last
            longest[at + 1 - len(pattern)] = (at, pattern, weight)
        free = 0
        for start in sorted(longest):
            if start >= free:
                free = longest[start][0] + 1
                yield longest[start]

    def features(self, text: str | None) -> tuple[int, float, int, int]:
        """Hits, their weight (a term's again counts ever less), different terms, words."""
        folded = fold(text)
        met = Counter(pattern for _, pattern, weight in self.hits(folded) if weight)
        weight = sum(math.log2(1 + n) * self.automaton.get(p)[1] for p, n in met.items())
        return sum(met.values()), weight, len(met), len(folded.split())

    def scores(self, rows: list[tuple[int, float, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(layer_inputs(rows) @ self.layer, -60, 60)))


def layer_inputs(rows: list[tuple[int, float, int, int]]) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(-1, 4)
    return np.stack([np.ones(len(x)), np.log1p(x[:, 1]), np.log1p(100 * x[:, 1] / (x[:, 3] + 20)), np.log1p(x[:, 2])], axis=1)


_made: dict[str, Matcher] = {}


def matcher(lexicon: Lexicon) -> Matcher:
    """One automaton for each Python worker."""
    if lexicon.key not in _made:
        _made.clear()
        _made[lexicon.key] = Matcher(lexicon)
    return _made[lexicon.key]


def _score(lexicon: Lexicon, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    match = matcher(lexicon)
    for batch in batches:
        rows = [match.features(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
        p = match.scores(rows)
        keep = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out")]
        more = [pa.array((p >= threshold).astype(np.int32)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(p), *more], names=[c.split()[0] for c in SCORES.split(", ")])
    release()


def in_fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, hits, weight."""
    held = F.coalesce(in_fold() == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    return rows.mapInArrow(lambda batches: _score(shared.value, threshold, batches), SCORES)


def _counted(patterns: Callable[[str], set[str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of either label each pattern is, as far as a task has seen."""
    count: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(count[0] | count[1])
        made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([count[k][n] for n in names], pa.int64()) for k in (1, 0))], names=["pattern", "toxic", "clean"])
        count[0].clear()
        count[1].clear()
        return made

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count[label].update(patterns(fold(text)))
            if len(count[0]) + len(count[1]) > AT_ONCE:
                yield out()
    yield out()


def beginnings(folded: str) -> set[str]:
    """A space and the first letters of each word, of every length that a term may have."""
    return {" " + w[:k] for w in set(folded.split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def surroundings(match: Matcher, folded: str) -> set[str]:
    """For each hit: its whole word, that with the word after it, and with the word before it."""
    out = set()
    words = None
    for at, pattern, weight in match.hits(folded):
        if not weight:
            continue
        if words is None:
            words = folded.split()
            starts = np.array([i for i in range(len(folded) - 1) if folded[i] == " " and folded[i + 1] != " "])
        k = int(np.searchsorted(starts, at - len(pattern) + 1))
        word = " " + words[k]
        out.update({word} - {pattern})
        if k + 1 < len(words):
            out.add(f"{word} {words[k + 1]}")
        if k:
            out.add(f" {words[k - 1]}{word}")
    return out


def leading(match: Matcher, folded: str) -> set[str]:
    """The few patterns of greatest weight: those that tell that the text is toxic, if it is."""
    met = {pattern: weight for _, pattern, weight in match.hits(folded)}
    return set(sorted(met, key=lambda p: (-met[p], p))[:LEADING])


def interval(toxic: F.Column, clean: F.Column, n_toxic: int, n_clean: int) -> tuple[F.Column, F.Column]:
    """Log odds of a pattern between toxic and clean rows, and the width of its interval to either side."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    return odds, WIDTH * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lower(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The lower end of interval()."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds - WIDTH * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def explained(terms: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the terms with (toxic, clean) rows that others don't make needless.

    A shorter term in the same rows as a longer one goes.  A longer term of as great a weight takes its rows away from a shorter one; one of no
    greater weight than a shorter one goes.
    """
    needless = {p[:k] for p, rows in terms.items() for k in range(SHORTEST + 1, len(p)) if terms.get(p[:k]) == rows}
    terms = {p: rows for p, rows in terms.items() if p not in needless}
    weight = {p: lower(*rows, n_toxic, n_clean) for p, rows in terms.items()}
    best: dict[str, tuple[float, str]] = {}
    for p in terms:
        for k in range(SHORTEST + 1, len(p)):
            best[p[:k]] = max(best.get(p[:k], (-math.inf, "")), (weight[p], p), key=lambda x: (x[0], len(x[1]), x[1]))
    kept: dict[str, float] = {}
    for p in sorted(terms, key=len):
        toxic, clean = terms[p]
        own = weight[p]
        if p in best and best[p][0] >= own:
            toxic, clean = (max(a - b, 0) for a, b in zip((toxic, clean), terms[best[p][1]], strict=True))
            own = lower(toxic, clean, n_toxic, n_clean)
        shorter = next((kept[p[:k]] for k in range(len(p) - 1, SHORTEST, -1) if p[:k] in kept), -math.inf)
        if toxic >= LEAST_ROWS and own >= LEAST_WEIGHT and own > shorter:
            kept[p] = own
    return kept


def fitted_layer(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1e-2) -> tuple[float, float, float, float]:
    """Logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - y) + penalty * b
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (penalty + 1e-6) * np.eye(len(b)), slope)
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, terms: int = TERMS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows outside the held-out fold, of at most ``terms`` patterns of each kind."""
    known = labels.where(F.col(label).isin(0, 1) & (in_fold() != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ``rows`` is what bounds the side that is sent
    sample = written(texts.join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"), "label").agg(F.first("text").alias("text")).select("text", "label"))
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 2)
    none = Lexicon({}, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    if not n_toxic or not n_clean:
        discard(sample)
        return none

    def counted(patterns: Callable[[str], set[str]]) -> DataFrame:
        found = sample.mapInArrow(lambda batches: _counted(patterns, batches), COUNTS)
        found = found.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds, width = interval(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
        return found.withColumns({"least": odds - width, "most": odds + width})

    found = counted(beginnings).where((F.col("toxic") >= LEAST_ROWS) & (F.col("least") >= LEAST_WEIGHT)).orderBy(F.desc("least"), "pattern").limit(terms).collect()
    lexicon = Lexicon(explained({r["pattern"]: (r["toxic"], r["clean"]) for r in found}, n_toxic, n_clean))
    first = docs.sparkSession.sparkContext.broadcast(lexicon)
    telling = {r["pattern"] for r in counted(lambda folded: leading(matcher(first.value), folded)).where(F.col("toxic") >= LEAST_ROWS).collect()}
    lexicon = Lexicon({p: w for p, w in lexicon.weights.items() if p in telling})
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    clean = counted(lambda folded: surroundings(matcher(shared.value), folded)).where((F.col("clean") >= LEAST_ROWS) & (F.col("most") <= 0)).orderBy("most", "pattern").limit(terms).collect()
    lexicon = Lexicon(lexicon.weights | {r["pattern"]: 0.0 for r in clean}, none.layer)
    if lexicon.weights:
        again = docs.sparkSession.sparkContext.broadcast(lexicon)
        seen = sample.mapInArrow(lambda batches: _features(again.value, batches), "label int, hits long, weight double, terms long, words long").collect()
        lexicon = Lexicon(lexicon.weights, fitted_layer(layer_inputs([tuple(r)[1:] for r in seen]), np.array([r["label"] for r in seen], np.float64)))
    discard(sample)
    return lexicon


def _features(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    match = matcher(lexicon)
    for batch in batches:
        rows = [match.features(x.as_py()) for x in batch.column(0)]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["label", "hits", "weight", "terms", "words"])
