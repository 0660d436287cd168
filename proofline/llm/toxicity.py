"""Operator 3, toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases a text, drops accents and characters of no width, writes homoglyphs (letters of other scripts, full-width and styled
forms) as the Latin letters they look like, reads digits and signs inside words as the letters they stand for, and puts one space for everything
that is no letter. As ``1``, ``!`` and ``|`` may stand for i or l, these two become one letter, in the lexicon too. The lexicon holds
words and word beginnings (so inflected forms count), each weighted by the log-odds of toxic against other training
documents. Its matches are found by one Aho-Corasick automaton; a word counts once, with its heaviest entry. Words inside an
exception phrase don't count. The sum is divided by the number of words, and a logistic curve fitted on the training documents turns
it into a score from 0 to 1.

Training uses a bounded sample: about ``TRAIN_DOCS`` labelled documents, drawn by a hash of doc_id, none of them held out.
Entries are features of ``MIN_DOCS`` (and one in ``MIN_SHARE``) of the sample's toxic documents at least, so the lexicon, all that is collected or
sent to executors, is bounded by the sample.

Defined results: a null or empty text has no words and no matches, and gets the curve's value there. Labels that are null, or whose
document is missing, are not used; of several labels of a doc_id the largest counts. Without any toxic training document every score is 0. Repeated rows each get their own, equal result;
rows with a null doc_id are never held out. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import discard, documents, drawn, materialize, small_batches, text_or_empty

TRAIN_DOCS = 20_000
MIN_WEIGHT = 3.0
MIN_DOCS = 4
MIN_SHARE = 200
PREFIXES = range(4, 9)
FLUSH = 400_000
THRESHOLD = 0.3

# Letters of other scripts and the Latin letters that they look like.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнԛԝүգոսցαοερτυικνχγωηßøłđıɑɡɩʀ", "aeopcyxijsdhlkmtbhqwyqnuqaoeptuikvxywnsoldiagir", strict=True))
# Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Harmless phrases that contain words of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "white trash bag", "sore loser rule")
SIGNS = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
#: Characters of no width, which split words unseen.
UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
NUMBERS = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def folded_char(c: str) -> str:
    plain = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c) if c.isdigit() else c)
    if plain == c and ord(c) > 127:
        return "".join(folded_char(p) for p in unicodedata.normalize("NFKD", c).lower() if p != c and not unicodedata.combining(p)) or (c if c.isalpha() else "" if unicodedata.combining(c) else " ")
    return ("i" if plain == "l" else plain) if plain.isalpha() else " "


class Folds(dict):
    """Code point to its folded characters, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = folded_char(chr(code))
        return self[code]


FOLDS = Folds()


def fold(text: str) -> str:
    """The folded text, with one space at either end; words are what stands between spaces."""
    low = text.lower()
    if not low.isascii():
        low = UNSEEN.sub("", low)
    if any(c in low for c in "@$!|"):
        low = SIGNS.sub(lambda m: SUBSTITUTES[m[0]], low)
    return " " + NUMBERS.sub(" ", low).translate(FOLDS) + " "


def features(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, pos, neg), added up as far as memory allows."""
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def rows() -> pa.RecordBatch:
        every = list(found[1].keys() | found[0].keys())
        out = pa.RecordBatch.from_pydict({"feature": pa.array(every, pa.string()), "pos": pa.array([found[1][f] for f in every], pa.int64()), "neg": pa.array([found[0][f] for f in every], pa.int64())})
        for counter in found.values():
            counter.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            found[toxic].update(features(fold(text)))
            if len(found[0]) + len(found[1]) > FLUSH:
                yield rows()
    yield rows()


def choose(rows: Iterable[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Entries with their weights: the longest of features with the same support, and no forms of an entry as heavy."""
    weight = {f: float(np.log((pos + 0.5) / (positives + 1)) - np.log((neg + 0.5) / (negatives + 1))) for f, pos, neg in rows}
    support = {f: pos for f, pos, _ in rows}
    best: dict[str, int] = {}  # the widest support of any longer form
    for f in weight:
        for k in range(len(f)):
            if f[:k] in support:
                best[f[:k]] = max(best.get(f[:k], 0), support[f])
    kept: dict[str, float] = {}
    for f in sorted(weight, key=lambda f: (len(f), f)):
        if best.get(f, 0) >= 0.95 * support[f]:
            continue
        if not any(f[:k] in kept and kept[f[:k]] >= weight[f] - 0.5 for k in range(1, len(f))):
            kept[f] = weight[f]
    return kept


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in lexicon.items():
            self.automaton.add_word(entry, (len(entry.rstrip()), len(entry), w))
        for phrase in exceptions:
            phrase = fold(phrase)
            self.automaton.add_word(phrase, (0, len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def total(self, folded: str) -> tuple[float, int]:
        """The weights of all words matched, and how many there are."""
        words: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (kind, length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if kind:
                    words[start] = max(words.get(start, 0.0), weight)
                else:
                    harmless.append((start, end))
            for start, end in harmless:
                for place in [p for p in words if start <= p < end]:
                    del words[place]
        return sum(words.values()), len(words)


def strength(lexicon: dict[str, float], exceptions: Iterable[str], keep: list[str]):
    """Replace text by ``x`` (log of the weights per hundred words) and ``n_matches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            x, n = [], []
            for text in batch["text"].to_pylist():
                folded = fold(text)
                total, matches = matcher.total(folded)
                x.append(float(np.log1p(100 * total / len(folded.split()))) if matches else 0.0)
                n.append(matches)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(x), pa.array(n, pa.int64())], names=[*keep, "x", "n_matches"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of a logistic curve, by Newton's method with a small penalty on the slope."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    penalty = np.array([1e-6, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9), design.T @ (y - p) - penalty * beta)
        beta = beta + np.clip(step, -5, 5)
    return float(beta[0]), float(beta[1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """A lexicon with exceptions and the curve that turns its strength into a score."""

    def __init__(self, lexicon: dict[str, float], curve: tuple[float, float] | None, exceptions: Iterable[str] = EXCEPTIONS):
        self.lexicon, self.curve, self.exceptions = lexicon, curve, tuple(exceptions)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score and n_matches of every row."""
        small_batches(docs.sparkSession)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(strength(self.lexicon, self.exceptions, ["doc_id"]), "doc_id long, x double, n_matches long")
        score = F.lit(0.0) if self.curve is None else 1 / (1 + F.exp(-(F.lit(self.curve[0]) + F.lit(self.curve[1]) * F.col("x"))))
        return found.select("doc_id", score.alias("score"), "n_matches")


def train(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, train_docs: int = TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_docs / max(1, usable.count()))
    some = usable.where(drawn(F.col("doc_id"), share))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id").select("text", "toxic")
    sample = materialize(texts, "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    if not positives:
        return Model({}, None, exceptions)
    counts = sample.mapInArrow(count_features, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("neg") + 0.5) / (negatives + 1))
    strong = counts.where((F.col("pos") >= max(MIN_DOCS, positives // MIN_SHARE)) & (odds >= MIN_WEIGHT))
    lexicon = choose([tuple(r) for r in strong.collect()], positives, negatives)
    measured = sample.mapInArrow(strength(lexicon, exceptions, ["toxic"]), "toxic int, x double, n_matches long").select("toxic", "x").toPandas()
    discard(sample)
    return Model(lexicon, fit_curve(measured["x"].to_numpy(float), measured["toxic"].to_numpy(float)), exceptions)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")
