"""Text quality from heuristic labellers of unknown accuracy.

Each labeller votes good (1), bad (-1) or abstains (0) on a whole text. Their
votes on all documents are counted by pattern, and expectation maximisation
over the counts estimates how often each labeller votes right, wrong or not at
all on good and on bad texts. The posterior of a text's pattern is its weak
label. A linear scorer over hashed spellings, ends and shapes of words learns the weak labels of a bounded sample, and scores every whole text.
"""

from __future__ import annotations

import operator
import pickle
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolmark.llm import tables
from spoolmark.llm.shingles import encoded
from spoolmark.llm.subwords import Remembered
from spoolmark.llm.tables import Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELLERS = ("symbols", "capitals", "bars", "sentences", "marks", "word_length", "lines", "echoes")
SAMPLE = 3000  # most rows of each weak label that the scorer learns from
SAMPLE_BYTES = 1 << 24  # of the texts of either label, from which no further row is used
SLOTS = 1 << 16
SLICE = 1 << 20
FALSE_ALARM = 5e-4  # a labeller votes bad on so few good texts at most

VOTES = "doc_id BIGINT, votes STRING"
SCORES = "doc_id BIGINT, score DOUBLE, words BIGINT"


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 blank, 2 letter, 3 capital, 4 symbol, 5 bar, 6 stop, 7 mark."""
    kind = np.zeros(256, np.int64)
    kind[33:127] = 4
    kind[[9, 10, 11, 12, 13, 32]] = 1
    kind[97:123] = 2
    kind[128:] = 2
    kind[65:91] = 3
    kind[48:58] = 0
    kind[[ord(c) for c in ",;:'\"()-"]] = 0
    kind[ord("|")] = 5
    kind[[ord("."), ord("?")]] = 6
    kind[ord("!")] = 7
    return kind


_KINDS = _classes()


def measures(text: bytes) -> np.ndarray:
    """Counts over a whole text: of each class of bytes, of words, and of lines and distinct lines, and of words like the one before."""
    counts = np.zeros(8, np.int64)
    words, before = 0, True
    for k in range(0, len(text), SLICE):
        kind = _KINDS[np.frombuffer(text, np.uint8, min(SLICE, len(text) - k), k)]
        counts += np.bincount(kind, minlength=8)
        blank = kind == 1
        words += int((~blank[1:] & blank[:-1]).sum()) + int(before and not blank[0])
        before = bool(blank[-1])
    lines = [x for x in text.split(b"\n") if len(x) > 20]
    return np.array([*counts, words, len(lines), len(set(lines)), echoes(text.split())], float)


def echoes(words: list) -> int:
    return sum(map(operator.eq, words, words[1:]))


def votes(measured: np.ndarray) -> str:
    """One letter per labeller: g, b or a dash."""
    other, _, small, capital, symbol, bar, stop, mark, words, lines, distinct, echoed = measured
    letters = small + capital
    if not words or not letters:
        return "b" * len(LABELLERS)
    judged = (
        (symbol / letters, 0.02, 0.06),
        (capital / letters, 0.15, 0.4),
        (bar / words, 0.0, 0.15),
        (-stop / words, -0.02, -0.004 if words > 60 else 1),
        (mark / words, 0.02, 0.2),
        (abs(letters / words - 6), 4, 8),
        (1 - distinct / lines if lines > 2 else 0.0, 0.1, 0.4),
        (echoed / words, 0.05, 0.3),
    )
    return "".join("g" if x <= good else "b" if x >= bad else "-" for x, good, bad in judged)


def vote(docs: DataFrame) -> DataFrame:
    """doc_id and votes of every whole text."""

    def run(batches):
        for batch in batches:
            found = [votes(measures(t)) for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], names=["doc_id", "votes"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), tables.text_of()).mapInArrow(run, VOTES)


def estimate(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good by pattern, and what each labeller does on each class.

    The second is [labeller, class (bad, good), vote (b, -, g)]. Labellers count
    as independent given the class. At the start each is taken to know one kind of
    bad text and to call most others good, so that one bad vote among good ones
    counts for bad; from a start where it does not, the bad class of a small
    table shrinks to the texts that several labellers agree on. A bad
    vote is taken as precise: ``FALSE_ALARM`` bounds its share on good texts.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.empty((len(LABELLERS), 2, 3))
    code = np.array([["b-g".index(v) for v in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    does = np.tile(np.array([[0.2, 0.1, 0.7], [0.01, 0.19, 0.8]]), (len(LABELLERS), 1, 1))
    prior = np.array([0.2, 0.8])
    each = np.arange(len(LABELLERS))
    for _ in range(rounds):
        joint = np.log(prior) + np.log(does[each, :, code]).sum(axis=1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint /= joint.sum(axis=1, keepdims=True)
        mass = joint * weight[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + 2)
        for k in each:
            for v in range(3):
                does[k, :, v] = mass[code[:, k] == v].sum(axis=0) + 0.5
            does[k] /= does[k].sum(axis=1, keepdims=True)
            does[k, 1, 0] = min(does[k, 1, 0], FALSE_ALARM)
    return dict(zip(patterns, joint[:, 1].tolist(), strict=True)), does


def _features(word: str) -> list[int]:
    """Slots of a word's spelling, its last characters, its first and its shape."""
    shape = "A" if word.isupper() and len(word) > 1 else "a" if word.isalpha() else "0"
    named = (f"w{word}", f"e{word[-3:]}", f"b{word[0]}", f"s{shape}{word[-1]}")
    return [zlib.crc32(n.encode()) % (SLOTS - 1) for n in named]


ECHO = SLOTS - 1  # slot of the share of words like the one before


def fit(texts: list[str], labels: np.ndarray, rounds: int = 30) -> dict:
    """Weights of the scorer by weak labels from 0 to 1; one sort of label makes a constant."""
    if not len(texts) or (labels >= 0.5).all() or (labels < 0.5).all():
        return {"constant": float(labels.mean()) if len(texts) else 1.0}
    seen = Remembered(_features, 500_000)
    rows, slots, values = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        flat = [s for w in words for s in seen[w]]
        flat += [ECHO] * echoes(words)
        slot, count = np.unique(np.array(flat, np.int64), return_counts=True)
        rows.append(np.full(len(slot), k))
        slots.append(slot)
        values.append(count / max(1, len(words)))
    rows, slots, values = map(np.concatenate, (rows, slots, values))
    weight, bias = np.zeros(SLOTS), 0.0
    power = np.full(SLOTS, 1e-8)
    for _ in range(rounds):
        total = bias + np.bincount(rows, values * weight[slots], len(texts))
        wrong = (0.5 + 0.5 * np.tanh(0.5 * total) - labels) / len(texts)
        grad = np.bincount(slots, values * wrong[rows], SLOTS) + 1e-6 * weight
        power += grad * grad
        weight -= 0.5 * grad / np.sqrt(power)
        bias -= 2.0 * float(wrong.sum())
    return {"weight": weight, "bias": bias}


def learn(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[dict, np.ndarray]:
    """The scorer, and what the labellers do, from all ``docs``.

    Votes are counted over all documents; the patterns number 3 to the power of
    the labellers at most. The scorer learns, in one task, from at most ``sample``
    rows of each weak label by the hash of their id, taken until their texts have
    ``most_bytes``. The driver gets the counts and the model.
    """
    work = Workspace(docs.sparkSession, "quality")
    voted = work.keep(vote(docs), "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    posterior, does = estimate(counts)
    good = [p for p, x in posterior.items() if x >= 0.5]
    # One pass ranks both labels; the sample is bounded, and so is its broadcast.
    labelled = voted.select("doc_id", "votes", F.col("votes").isin(good).alias("good"))
    labelled = labelled.where("doc_id IS NOT NULL")
    parts = [
        labelled.where(F.col("good") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for side in (True, False)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]).groupBy("doc_id").agg(F.min("votes").alias("votes")))
    texts = docs.select(F.col("doc_id").cast("bigint"), tables.text_of().alias("text"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "votes").agg(F.min("text").alias("text"))
    order = Window.partitionBy(F.col("votes").isin(good)).orderBy(F.xxhash64("doc_id"), "doc_id")
    before = F.sum(F.octet_length("text")).over(order) - F.octet_length("text")
    rows = rows.withColumn("before", before).where(F.col("before") < most_bytes)

    def run(batches):
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found.sort()
        model = fit([text for _, _, text in found], np.array([posterior[v] for _, v, _ in found]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select("doc_id", "votes", "text").repartition(1).mapInArrow(run, "model BINARY")
    made = made.collect()
    model = pickle.loads(made[0]["model"]) if made else fit([], np.empty(0))  # no rows, no task
    work.drop(voted)
    return model, does


class Scorer:
    """Scores whole texts; remembers the weights of words."""

    def __init__(self, model: dict) -> None:
        self.constant = model.get("constant")
        if self.constant is None:
            weight = model["weight"]
            self.bias, self.echo = model["bias"], float(weight[ECHO])
            self.known = Remembered(lambda word: float(weight[_features(word)].sum()), 200_000)

    def score(self, text: str) -> tuple[float, int]:
        """Score and number of words."""
        words = text.split()
        if not words or self.constant is not None:
            return (self.constant or 0.0) if words else 0.0, len(words)
        total = sum(map(self.known.__getitem__, words)) + self.echo * echoes(words)
        return float(0.5 + 0.5 * np.tanh(0.5 * (self.bias + total / len(words)))), len(words)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and words of every whole text of ``docs``.

    A null or empty text has no words and scores 0; a null doc_id is kept;
    repeated rows score alike; an empty table gives no rows; further columns
    are ignored.
    """

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores, sizes = [], []
            for text in batch.column(1).to_pylist():
                score, size = scorer.score(text)
                scores.append(score)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "score", "words"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), tables.text_of()).mapInArrow(run, SCORES)


def good_documents(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``limit`` at least, with all their columns, unshuffled."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "")[0] >= limit for t in texts]))

    return docs.mapInArrow(run, docs.schema)
