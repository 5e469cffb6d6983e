"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string of symbols, one per word and clause end. Letter-to-letter transducers rewrite it: negation marks
insults and threats shortly after a negation word, reported speech those after a verb of saying or a quotation mark, target
those in a clause with an addressed person, threat a threatening verb followed by its target. Their composition is built once
and run over each text; each clause counts for the strongest pattern it holds, and a document's score is a logistic function
of the weights of its clauses.

The words and stems of insults are learned, beside fixed English ones, from labelled rows, and so are the weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.llm.shared import SLICE, extended, map_slices, stored

#: Labelled rows that lexicon and weights are learned from, about; a hash sample if there are more.
TRAINING_ROWS = 20_000
#: How often more a learned entry occurs in toxic documents (odds). Twice its log likelihood ratio against chance must pass
#: 2 * ln(terms that are tried), at which one of them does by chance.
LEAST_ODDS = 12.0
#: The same for weak entries, stems whose words, each but once a document, are counted; several in one text make it toxic.
WEAK_ODDS = 4.0
#: Toxic documents that an entry must hit for each other one that it hits.
FALSE_COST = 10
#: Lengths of stems, those of stems of short words, and how many letters a short word has besides.
STEMS, SHORT_STEMS, TAIL = range(4, 8), range(3, 8), 4
#: Words of which a worker remembers the symbol; terms that it counts before it hands their counts on, and bits of a count.
REMEMBERED, COUNTED, COUNT_BITS = 200_000, 100_000, 40

# Small closed word classes in the corpus's languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting imbecile".split()
THREATS = "kill hurt destroy beat stab shoot strangle burn töten tuer matar".split()
TARGETS = "you your you're u he she they him her them this that du dich sie tu toi vous usted tú".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say claimed wrote quoted called told sagte schrieb dit écrit dijo escribió".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: Patterns a clause may hold, strongest first: threat with target, insult with target, insult, threat, reported, negated.
PATTERNS = "KJIVrn"
#: Weights before learning, per log2(1 + clauses) of a pattern, log2(1 + weak words), and the constant last.
PRIOR = np.array([3.0, 3.0, 2.5, 0.5, 0.5, -0.5, 0.8, -2.5])


@dataclass
class Transducer:
    """Letter-to-letter: (state, symbol) to (state, symbol). Symbols without an entry pass, and lead to ``otherwise``."""

    arcs: dict[tuple[object, str], tuple[object, str]]
    otherwise: dict[object, object] = field(default_factory=dict)
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol)

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """The composition over reachable pairs of states: this one's output is the other's input."""
        start = (self.start, other.start)
        arcs: dict[tuple[object, str], tuple[object, str]] = {}
        waiting, seen = [start], {start}
        while waiting:
            one, two = state = waiting.pop()
            for symbol in alphabet:
                next_one, between = self.step(one, symbol)
                next_two, out = other.step(two, between)
                arcs[state, symbol] = (next_one, next_two), out
                if (next_one, next_two) not in seen:
                    seen.add((next_one, next_two))
                    waiting.append((next_one, next_two))
        return Transducer(arcs, start=start)


#: o other word, I insult, V threat verb, T target, N negation, R reported speech, W weak word, "." clause end.
ALPHABET = "oIVTNRW."


def grammar() -> Transducer:
    negation = Transducer(
        {(left, "N"): (3, "o") for left in range(4)}
        | {(left, hit): (left - 1, "n") for left in (1, 2, 3) for hit in "IV"}
        | {(left, "."): (0, ".") for left in range(4)},
        otherwise={3: 2, 2: 1, 1: 0, 0: 0},
    )
    reported = Transducer(
        {(state, "R"): (1, "o") for state in (0, 1)} | {(1, hit): (1, "r") for hit in "IV"} | {(1, "."): (0, ".")}
    )
    # States: 0 nothing, 1 a target was seen, 2 an insult was seen.
    target = Transducer(
        {(0, "T"): (1, "T"), (2, "T"): (1, "J"), (0, "I"): (2, "I"), (1, "I"): (1, "J")} | {(state, "."): (0, ".") for state in (0, 1, 2)}
    )
    threat = Transducer(
        {(left, "V"): (3, "V") for left in range(4)}
        | {(left, aim): (0, "K") for left in (1, 2, 3) for aim in "TJ"}
        | {(left, "."): (0, ".") for left in range(4)},
        otherwise={3: 2, 2: 1, 1: 0, 0: 0},
    )
    composed = negation
    for one in (reported, target, threat):
        composed = composed.then(one, ALPHABET)
    return composed


_CLOSED = {word: symbol for symbol, words in zip("RNTVI", (REPORTS, NEGATIONS, TARGETS, THREATS, INSULTS)) for word in words}


class Lexicon:
    """Symbols of words: closed classes, then learned insults as whole words, as stems, or as stems of short words.

    Weak words, stems of short words that tell little alone, have a symbol of their own.
    """

    def __init__(self, words: set[str], stems: set[str], short: set[str] = frozenset(), weak: set[str] = frozenset()) -> None:
        self._words, self._stems, self._short, self._weak = words, stems, short, weak
        self._weak_lengths = sorted({len(stem) for stem in weak})
        self._lengths = sorted({len(stem) for stem in stems})
        self._short_lengths = sorted({len(stem) for stem in short})
        self._known = self._fixed()

    @staticmethod
    def _fixed() -> dict[str, str]:
        return _CLOSED | dict.fromkeys(".!?;:,\n", ".") | dict.fromkeys('"“”«»', "R")

    def symbols(self, text: str | None) -> str:
        tokens = _TOKEN.findall((text or "").lower())
        found = list(map(self._known.get, tokens))
        if None in found:
            found = [self._symbol(token) if symbol is None else symbol for token, symbol in zip(tokens, found)]
        return "".join(found)

    def _symbol(self, word: str) -> str:
        hit = word in self._words or any(word[:n] in self._stems for n in self._lengths if len(word) > n)
        hit = hit or any(word[:n] in self._short for n in self._short_lengths if n < len(word) <= n + TAIL)
        if len(self._known) >= REMEMBERED:
            self._known = self._fixed()
        weak = any(word[:n] in self._weak for n in self._weak_lengths if n < len(word) <= n + TAIL)
        self._known[word] = "I" if hit else "W" if weak else "o"
        return self._known[word]


def clauses(symbols: str, machine: Transducer) -> list[int]:
    """Number of clauses by strongest pattern, in the order of PATTERNS, and of weak words."""
    counts = [0] * len(PATTERNS) + [symbols.count("W")]
    if "I" not in symbols and "V" not in symbols:
        return counts
    state, best = machine.start, len(PATTERNS)
    for symbol in symbols + ".":
        state, out = machine.arcs[state, symbol]
        if out == ".":
            if best < len(PATTERNS):
                counts[best] += 1
            best = len(PATTERNS)
        elif out in PATTERNS:
            best = min(best, PATTERNS.index(out))
    return counts


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether labels of a row are kept from learning: crc32 of doc_id as text modulo ``folds`` is 0. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents that are not held out; the broadcast side has that bound.

    Rows without a label or a document are left out; of conflicting labels of one doc_id the larger counts.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, 0.97 * rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    chosen = chosen.groupBy(F.col("doc_id").alias("__doc_id")).agg(F.max(label).cast("int").alias("label"))
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc_id")).select("text", "label")


def without_copies(training: DataFrame) -> DataFrame:
    """One row of each group of copies, edited ones too: copies would make any of their words look like evidence.

    Rows with the same smallest hash of three-word shingles count as copies, tried with two hash functions. Texts of fewer
    words are compared as a whole.
    """

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys: tuple[list[int], list[int]] = ([], [])
        for text in batch.column(0).to_pylist():
            words = (text or "").lower().split()
            shingles = [" ".join(run) for run in zip(words, words[1:], words[2:])] or [" ".join(words)]
            for seed, column in enumerate(keys):
                column.append(min(xxhash.xxh64_intdigest(shingle, seed) for shingle in shingles) - (1 << 63))
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys)], names=["text", "label", "one", "two"])

    sketched = map_slices(training, sketch, "text string, label int, one long, two long")
    # Of each group the smallest text, so that reruns learn the same.
    once = sketched.groupBy("label", "one").agg(F.min(F.struct("text", "two")).alias("row")).select("label", "row.*")
    return once.groupBy("label", "two").agg(F.min("text").alias("text")).select("text", "label")


def learned_lexicon(training: DataFrame) -> Lexicon:
    """Words and stems that occur in toxic rows far more often than elsewhere, beyond chance."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Four counts share a number, which takes far less memory than a list of them.
        totals: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = set(_WORD.findall((text or "").lower()))
                    terms = {"=" + word for word in words if len(word) >= STEMS[0]}
                    terms |= {word[:n] for word in words for n in STEMS if len(word) > n}
                    terms.add("")
                    once = (1 | 1 << 2 * COUNT_BITS) << (COUNT_BITS if toxic else 0)
                    for term in terms:
                        totals[term] = totals.get(term, 0) + once
                    families = Counter("~" + word[:n] for word in words for n in SHORT_STEMS if n < len(word) <= n + TAIL)
                    for term, different in families.items():
                        totals[term] = totals.get(term, 0) + ((1 | different << 2 * COUNT_BITS) << (COUNT_BITS if toxic else 0))
                    if len(totals) > COUNTED:
                        yield _counts(totals)
                        totals = {}
        yield _counts(totals)

    names = ["others", "toxic", "other_words", "toxic_words"]
    counts = without_copies(training).mapInArrow(counted, "term string, " + ", ".join(f"{name} long" for name in names))
    sums = counts.groupBy("term").agg(*[F.sum(name).alias(name) for name in names])
    # Terms of one toxic row are the many, and of no use.
    sums = stored(sums.where("toxic > 1"), "terms")
    everything = sums.where("term = ''").first()
    if everything is None or not everything["others"]:
        return Lexicon(set(), set())
    share = everything["toxic"] / (everything["toxic"] + everything["others"])
    least = 2 * math.log(sums.count())

    def evidence(a: Column, b: Column, least_odds: float) -> Column:
        odds = (a + 0.5) / (b + 0.5) * F.lit((1 - share) / share)
        ratio = a * F.log(a / (a + b) / F.lit(share)) + F.when(b > 0, b * F.log(b / (a + b) / F.lit(1 - share))).otherwise(0.0)
        return (F.col("term") != "") & (odds >= least_odds) & (2 * ratio >= least)

    gain = (F.col("toxic") - FALSE_COST * F.col("others")).alias("gain")
    strong = sums.where(evidence(F.col("toxic"), F.col("others"), LEAST_ODDS)).select("term", gain)
    several = F.col("term").startswith("~") & (F.col("toxic") > 2) & (F.col("toxic_words") >= 1.5 * F.col("toxic"))
    weak = sums.where(several & evidence(F.col("toxic_words"), F.col("other_words"), WEAK_ODDS)).select("term").collect()
    words: set[str] = set()
    stems: set[str] = set()
    short: set[str] = set()
    # The best first; with equal gain the shorter entry explains the longer. A stem of a better entry only adds errors.
    ordered = strong.where("gain > 0").orderBy(F.desc("gain"), F.length("term"), "term")
    for (term,) in ordered.select("term").collect():
        kind, word = (term[0], term[1:]) if term[0] in "=~" else ("", term)
        if any(word[:n] in stems for n in STEMS):
            continue
        if kind == "=" and any(word[:n] in short for n in SHORT_STEMS if n < len(word) <= n + TAIL):
            continue
        if any(one.startswith(word) for one in (words | stems | short if kind != "~" else words | short)):
            continue
        {"=": words, "~": short, "": stems}[kind].add(word)
    return Lexicon(words, stems, short, {row["term"][1:] for row in weak})


def _counts(totals: dict[str, int]) -> pa.RecordBatch:
    mask = (1 << COUNT_BITS) - 1
    columns = [list(totals), *([n >> at * COUNT_BITS & mask for n in totals.values()] for at in range(4))]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, [pa.string(), *[pa.int64()] * 4])]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "others", "toxic", "other_words", "toxic_words"])


def learned_weights(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards PRIOR; with no rows it is PRIOR.

    Toxic rows, the rarer kind, weigh the square root of the ratio of the two, so that a miss counts for more than a false hit.
    """
    x = np.hstack([features, np.ones((len(features), 1))])
    toxic = float(labels.sum())
    row = np.where(labels > 0, max(1.0, (len(labels) - toxic) / max(1.0, toxic)) ** 0.5, 1.0)

    def loss(weights: np.ndarray) -> float:
        z = x @ weights
        return float((row * np.logaddexp(0, z)).sum() - (row * labels) @ z + ridge / 2 * np.sum((weights - PRIOR) ** 2))

    weights, now = PRIOR.copy(), loss(PRIOR)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (row * (labels - p)) - ridge * (weights - PRIOR)
        hessian = (x * (row * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        # A full step can overshoot: halve it until the loss falls.
        while (after := loss(weights + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        weights = weights + step
        if now - after < 1e-9:
            break
        now = after
    return weights


@dataclass
class Model:
    """Scores texts; small, and sent to the tasks as it is."""

    lexicon: Lexicon
    machine: Transducer
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        counts = clauses(self.lexicon.symbols(text), self.machine)
        total = float(self.weights[-1]) + sum(w * math.log2(1 + n) for w, n in zip(self.weights, counts) if n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """Learns from the labelled rows that are not held out. Without any, the fixed words and PRIOR weights remain."""
    training = training_rows(docs, labels, label, rows)
    lexicon, machine = learned_lexicon(training), grammar()

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        tally = Counter(
            (toxic, *clauses(lexicon.symbols(text), machine))
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        )
        columns = [[list(key) for key in tally], list(tally.values())]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.int64())], names=["key", "n"]
        )

    tallies = map_slices(training, counted, "key array<bigint>, n bigint").groupBy("key").agg(F.sum("n")).collect()
    keys = np.array([key for key, n in sorted(map(tuple, tallies)) for _ in range(n)], "f8").reshape(-1, len(PRIOR))
    return Model(lexicon, machine, learned_weights(np.log2(1 + keys[:, 1:]), (keys[:, 0] > 0).astype("f8")))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score, 0 to 1, of each whole text; null texts score as empty ones. No row is moved."""
    at = docs.columns.index(text_col)
    schema = extended(docs.schema, **{score_col: "double"})

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(text) for text in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return map_slices(docs, add, schema)
