"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words are runs outside white space. One of over ``LONG`` characters is cut, at
what is no letter or digit, and into overlapping pieces where that leaves long
ones; each piece enters as a word, so texts without spaces pass through windows
whole. A word enters as two vectors: that of its hashed spelling, and the sum of
those of its hashed character pieces, by the root of their number. Two gated recurrent units read a window
of words from either end; attention pools their states, and a linear layer
scores the window. Windows overlap by a third, all are scored, and the text's score
is that of its worst window, calibrated on the rows it was trained on.

Training is plain numpy in one task, on a sample of labelled rows that is bounded
in rows and bytes; the driver gets the model only.
Only whole-text labels exist, so each round trains on the window that the
network so far finds worst in each text, and on one at random. The vectors
start from the log-odds of spellings and pieces in the sample.
"""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolmark.llm import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, STRIDE = 24, 16
WORD_SLOTS, PIECE_SLOTS = 1 << 15, 1 << 14
WIDTH, HIDDEN = 8, 8
TOXIC_ROWS, CLEAN_ROWS = 1000, 2000  # most labelled rows that training uses
SAMPLE_BYTES = 1 << 24  # of the texts of either label, from which no further row is used
LONG = 40  # most characters of a word that is not cut
CUT, SHARED = 16, 4  # characters of a piece of a cut run, and of those the next one has too
ROUNDS, BATCH = 3, 128
STEPS = 60  # fewest steps of training, however few the rows are
DOUBT = 1.5  # standard errors that are taken off a log-odds
SLOW = 0.02  # of the rate for vectors of spellings and pieces, which else learn rows by heart

SCORES = "doc_id BIGINT, score DOUBLE, windows BIGINT, worst_word BIGINT"


_RUN = re.compile(r"[^\W_]+[\W_]{0,3}|[\W_]{1,8}")


def _cut(word: str) -> list[str]:
    """Pieces of a long word that hold all of its characters in order."""
    out = []
    for run in _RUN.findall(word):
        if len(run) <= LONG:
            out.append(run)
        else:
            out += [run[k : k + CUT] for k in range(0, len(run) - SHARED, CUT - SHARED)]
    return out


def words_of(text: str) -> tuple[list[str], np.ndarray | None]:
    """Words of a text, long ones cut; if any was, which word of the text each is from."""
    words = text.lower().split()
    if not words or max(map(len, words)) <= LONG:
        return words, None
    cut, owner = [], []
    for k, word in enumerate(words):
        pieces = [word] if len(word) <= LONG else _cut(word)
        cut += pieces
        owner += [k] * len(pieces)
    return cut, np.array(owner, np.int64)


def _slots(word: str) -> tuple[int, list[int]]:
    """Slot of a word's spelling and slots of its pieces of three and four characters."""
    data = f"<{word}>"
    pieces = [data[i : i + n] for n in (3, 4) for i in range(max(1, len(data) - n + 1))]
    return (
        1 + zlib.crc32(word.encode()) % (WORD_SLOTS - 1),
        [1 + zlib.crc32(p.encode()) % (PIECE_SLOTS - 1) for p in pieces],
    )


def _windows(count: int) -> np.ndarray:
    """First words of the windows over ``count`` words; none makes one empty window."""
    return np.arange(0, max(count - (WINDOW - STRIDE), 1), STRIDE)


class Words:
    """Numbers words as they come, up to a bound; 0 is the place after the end."""

    def __init__(self, most: int = 250_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.new: list[str] = []

    def __len__(self) -> int:
        return len(self.number)

    def of(self, words: list[str]) -> np.ndarray:
        number = self.number
        for word in set(words).difference(number):
            number[word] = len(number) + 1
            self.new.append(word)
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


class Slots:
    """Slots of many words: one of the spelling, and a run of those of the pieces."""

    def __init__(self, words: list[str]) -> None:
        self.spelling = np.empty(len(words), np.int64)
        self.sizes = np.empty(len(words), np.int64)
        pieces = array("i")
        for k, word in enumerate(words):
            self.spelling[k], own = _slots(word)
            self.sizes[k] = len(own)
            pieces.extend(own)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)
        self.pieces = np.array(pieces, np.int32)

    def runs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of some words, one after the other, and where each word's begin."""
        sizes = self.sizes[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        at = np.repeat(self.starts[rows] - starts, sizes) + np.arange(int(sizes.sum()))
        return self.pieces[at], starts


def _inputs(model: dict, slots: Slots, rows: np.ndarray) -> np.ndarray:
    """Vectors of words: spelling, and the sum of pieces by the root of their number."""
    out = np.zeros((len(rows), 2 * WIDTH), np.float32)
    if len(rows):
        pieces, starts = slots.runs(rows)
        out[:, :WIDTH] = model["word"][slots.spelling[rows]]
        total = np.add.reduceat(model["piece"][pieces], starts, axis=0)
        out[:, WIDTH:] = total / np.sqrt(slots.sizes[rows], dtype=np.float32)[:, None]
    return out


def _step(state, given, recurrent):
    """One step of a gated unit, squashed by x / (1 + |x|), which is cheaper than tanh.

    Returns the new state and what training needs.
    """
    h = HIDDEN
    gates = given[:, : 2 * h] + state @ recurrent[:, : 2 * h]
    gates = 0.5 + 0.5 * gates / (1 + np.abs(gates))
    update, reset = gates[:, :h], gates[:, h:]
    held = reset * state
    fresh = given[:, 2 * h :] + held @ recurrent[:, 2 * h :]
    fresh /= 1 + np.abs(fresh)
    return state + update * (fresh - state), (state, update, reset, held, fresh)


def _states(model: dict, given: list[np.ndarray], keep: bool = False):
    """States of both directions by place; ``given`` has the projected inputs of each."""
    steps, n = given[0].shape[:2]
    both = np.empty((steps, n, 2 * HIDDEN), np.float32)
    kept: list = [[None] * steps, [None] * steps]
    for d in (0, 1):
        state = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            state, needed = _step(state, given[d][t], model["recurrent"][d])
            both[t, :, d * HIDDEN : (d + 1) * HIDDEN] = state
            if keep:
                kept[d][t] = needed
    return both, kept


def _pooled(model: dict, both: np.ndarray):
    weight = both @ model["attend"]
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tnh,tn->nh", both, weight)
    return pooled @ model["out"] + model["bias"][0], pooled, weight


def _projected(model: dict, vectors: np.ndarray) -> np.ndarray:
    """What both directions' gates are given for words, side by side."""
    return np.concatenate([vectors @ m + b for m, b in zip(model["input"], model["gate_bias"], strict=True)], axis=1)


class Scorer:
    """Scores windows of texts; remembers the projected inputs of words."""

    def __init__(self, model: dict) -> None:
        self.model, self.words = model, Words()
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.table = np.tile(self.model["gate_bias"].ravel(), (1024, 1)).astype(np.float32)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        first, size = len(self.words) - len(new) + 1, len(self.words) + 1
        if size > len(self.table):
            grown = np.empty((2 * size, self.table.shape[1]), np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        vectors = _inputs(self.model, Slots(new), np.arange(len(new)))
        self.table[first:size] = _projected(self.model, vectors)

    def logits(self, numbers: np.ndarray) -> np.ndarray:
        """Of windows of word numbers (n, WINDOW)."""
        out = []
        for k in range(0, len(numbers), 2048):
            part = np.take(self.table, numbers[k : k + 2048].T, axis=0)
            given = [part[:, :, : 3 * HIDDEN], part[:, :, 3 * HIDDEN :]]
            out.append(_pooled(self.model, _states(self.model, given)[0])[0])
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest logit, number of windows and first word of the worst one, by text."""
        if len(self.words) > self.words.most:
            self._forget()
        best, counts = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        where = np.zeros(len(texts), np.int64)
        sources: dict[int, np.ndarray] = {}  # words of texts that pieces are from
        held: list = []  # (text, first word, word numbers) whose windows wait
        size = 0

        def flush():
            self._learn()
            index, owner, first = [], [], []
            flat = np.concatenate([n for _, _, n in held] + [np.zeros(WINDOW, np.int32)])
            base = 0
            for i, k, numbers in held:
                starts = _windows(len(numbers))
                places = starts[:, None] + np.arange(WINDOW)
                index.append(np.where(places < len(numbers), base + places, len(flat) - 1))
                owner.append(np.full(len(starts), i))
                first.append(k + starts)
                base += len(numbers)
            owner, first = np.concatenate(owner), np.concatenate(first)
            logits = self.logits(flat[np.concatenate(index)])
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            for at, end in zip(cuts, [*cuts[1:], len(owner)], strict=True):
                i, top = owner[at], at + int(logits[at:end].argmax())
                counts[i] += end - at
                if logits[top] > best[i]:
                    best[i], where[i] = logits[top], first[top]

        for i, text in enumerate(texts):
            words, source = words_of(text)
            if source is not None:
                sources[i] = source
            # A very long text goes by in parts that overlap as windows do.
            for k in range(0, max(len(words) - (WINDOW - STRIDE), 1), 96_000):
                numbers = self.words.of(words[k : k + 96_000 + WINDOW - STRIDE])
                held.append((i, k, numbers))
                size += len(numbers) + STRIDE
                if size > 50_000:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        for i, source in sources.items():
            where[i] = source[where[i]]
        return best, counts, where


def _start(rng, slots: Slots, docs: list[np.ndarray], labels: np.ndarray) -> dict:
    """Vectors whose first number is a log-odds; the rest small and random."""
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    model = {
        "word": rng.normal(0, 0.05, (WORD_SLOTS, WIDTH)).astype(np.float32),
        "piece": rng.normal(0, 0.05, (PIECE_SLOTS, WIDTH)).astype(np.float32),
        "input": scale(2, 2 * WIDTH, 3 * HIDDEN),
        "gate_bias": np.zeros((2, 3 * HIDDEN), np.float32),
        "recurrent": scale(2, HIDDEN, 3 * HIDDEN),
        "attend": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    for name, size, pick in (
        ("word", WORD_SLOTS, lambda rows: slots.spelling[rows]),
        ("piece", PIECE_SLOTS, lambda rows: slots.runs(rows)[0]),
    ):
        seen = np.zeros((2, size))
        for doc, label in zip(docs, labels, strict=True):
            rows = np.unique(doc)
            seen[int(label), np.unique(pick(rows[rows > 0] - 1))] += 1
        share = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
        odds = np.log(share[1] / share[0])
        # What chance explains counts for nothing: ``DOUBT`` standard errors are taken off.
        sure = np.maximum(np.abs(odds) - DOUBT * np.sqrt((1 / (seen + 0.5)).sum(axis=0)), 0)
        model[name][:, 0] = np.clip(np.sign(odds) * sure, -4, 4)
    model["word"][0] = model["piece"][0] = 0
    return model


def _gradients(model: dict, x: np.ndarray, labels: np.ndarray):
    """Loss gradients for inputs (WINDOW, n, 2 * WIDTH), by parameter and input."""
    h = HIDDEN
    given = [x @ model["input"][d] + model["gate_bias"][d] for d in (0, 1)]
    both, kept = _states(model, given, keep=True)
    logit, pooled, weight = _pooled(model, both)
    wrong = ((0.5 + 0.5 * np.tanh(0.5 * logit) - labels) / len(labels)).astype(np.float32)
    grad = {"out": pooled.T @ wrong, "bias": wrong.sum(keepdims=True)}
    d_pooled = wrong[:, None] * model["out"]
    d_weight = np.einsum("tnh,nh->tn", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tnh,tn->h", both, d_score)
    d_both = weight[:, :, None] * d_pooled + d_score[:, :, None] * model["attend"]
    d_x = np.zeros_like(x)
    grad["input"], grad["gate_bias"], grad["recurrent"] = (
        np.zeros_like(model[k]) for k in ("input", "gate_bias", "recurrent")
    )
    for d in (0, 1):
        u = model["recurrent"][d]
        d_given = np.empty_like(given[d])
        back = np.zeros((x.shape[1], h), np.float32)
        steps = range(len(x) - 1, -1, -1) if d == 0 else range(len(x))
        for t in steps:
            state, update, reset, held, fresh = kept[d][t]
            back = back + d_both[t, :, d * h : (d + 1) * h]
            d_fresh = back * update * (1 - np.abs(fresh)) ** 2
            d_held = d_fresh @ u[:, 2 * h :].T
            d_gates = np.concatenate(
                (
                    back * (fresh - state) * 0.5 * (1 - np.abs(2 * update - 1)) ** 2,
                    d_held * state * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2,
                ),
                axis=1,
            )
            grad["recurrent"][d][:, : 2 * h] += state.T @ d_gates
            grad["recurrent"][d][:, 2 * h :] += held.T @ d_fresh
            d_given[t] = np.concatenate((d_gates, d_fresh), axis=1)
            back = back * (1 - update) + d_held * reset + d_gates @ u[:, : 2 * h].T
        flat = d_given.reshape(-1, 3 * h)
        grad["input"][d] = x.reshape(-1, 2 * WIDTH).T @ flat
        grad["gate_bias"][d] = flat.sum(axis=0)
        d_x += d_given @ model["input"][d].T
    return grad, d_x


def train(rows: list[tuple[str, int]], seed: int = 7, rounds: int = ROUNDS) -> dict:
    """A model from (text, label) rows. With one label only, a constant score.

    Training takes ``rounds`` rounds over the rows and ``STEPS`` steps at least.
    Windows of the rarer label are repeated until they are a third of all.
    """
    labels = np.array([label for _, label in rows], int)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.0}
    rng = np.random.default_rng(seed)
    words = Words(sys.maxsize)
    docs = [words.of(words_of(text)[0]) for text, _ in rows]
    slots = Slots(list(words.number))
    every = np.arange(len(words))
    model = _start(rng, slots, docs, labels)
    # All windows of all rows; they are cut out in parts when they are read.
    places, owner, base = [], [], 0
    for k, doc in enumerate(docs):
        starts = _windows(len(doc))
        places.append(base + starts)
        owner.append(np.full(len(starts), k, np.int32))
        base += len(doc) + WINDOW
    places, owner = np.concatenate(places), np.concatenate(owner)
    end = np.zeros(WINDOW, np.int32)
    flat = np.concatenate([part for doc in docs for part in (doc, end)])
    del docs
    first = np.searchsorted(owner, np.arange(len(rows) + 1))

    def windows(part) -> np.ndarray:
        return flat[places[part][:, None] + np.arange(WINDOW)]

    def of_all(judge) -> np.ndarray:
        return np.concatenate([judge(windows(slice(k, k + 2048))) for k in range(0, len(places), 2048)])

    # At first a window is as bad as the spellings and pieces in it.
    vectors = np.concatenate((np.zeros((1, 2 * WIDTH), np.float32), _inputs(model, slots, every)))
    odds = vectors[:, 0] + vectors[:, WIDTH]
    logits = of_all(lambda part: odds[part].max(axis=1))
    moments: dict = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    steps = 0
    turn = 0
    while turn < rounds or steps < STEPS:
        turn += 1
        worst = np.array(
            [first[k] + logits[first[k] : first[k + 1]].argmax() for k in range(len(rows))]
        )
        other = rng.integers(first[:-1], first[1:])
        other = other[labels == 0]
        chosen = np.concatenate((worst, other))
        for label in (0, 1):
            own = chosen[labels[owner[chosen]] == label]
            more = (len(chosen) - len(own)) // (2 * len(own))
            chosen = np.concatenate((chosen, np.repeat(own, max(more - 1, 0))))
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            read = windows(part).T
            grad, d_x = _gradients(model, vectors[read], labels[owner[part]])
            steps += 1
            rate = 0.02 * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            d_word, d_piece = np.zeros_like(model["word"]), np.zeros_like(model["piece"])
            number = read.ravel()
            used, place = np.unique(number, return_inverse=True)
            total = np.zeros((len(used), 2 * WIDTH), np.float32)
            np.add.at(total, place.ravel(), d_x.reshape(-1, 2 * WIDTH))
            used, total = used[used > 0] - 1, total[used > 0]
            pieces, _ = slots.runs(used)
            sizes = slots.sizes[used]
            np.add.at(d_word, slots.spelling[used], total[:, :WIDTH])
            np.add.at(d_piece, pieces, np.repeat(total[:, WIDTH:] / np.sqrt(sizes)[:, None], sizes, axis=0))
            grad |= {"word": d_word, "piece": d_piece}
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                step = rate * SLOW if name in ("word", "piece") else rate
                model[name] -= (step * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            model["word"][0] = model["piece"][0] = 0
            vectors[used + 1] = _inputs(model, slots, used)
        vectors[1:] = _inputs(model, slots, every)
        scorer = Scorer(model)
        scorer.table = _projected(model, vectors)
        logits = of_all(scorer.logits)
    top = np.maximum.reduceat(logits, first[:-1]).astype(float)
    model["calibration"] = _calibrated(top, labels)
    return model


def _calibrated(top: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve over the texts' largest logits."""
    slope, offset = 1.0, 0.0
    for _ in range(500):
        wrong = 0.5 + 0.5 * np.tanh(0.5 * (slope * top + offset)) - labels
        slope -= 0.05 * float((wrong * top).mean()) + 0.0005 * (slope - 1)
        offset -= 0.2 * float(wrong.mean())
    return np.array([max(slope, 0.05), offset])


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = TOXIC_ROWS,
    clean: int = CLEAN_ROWS,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """doc_id, label and text of at most ``toxic`` and ``clean`` labelled rows, by the hash of their id.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Of either label,
    rows are taken until their texts have ``most_bytes``; the row that gets there
    is the last one. The bounds hold at every size, so the sample fits one task,
    and its ids can be broadcast. An id with two labels is toxic; of rows that
    repeat an id the least text is taken.
    """
    learn = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where(
        (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isin(0, 1)
    )
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    parts = [
        learn.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in ((1, toxic), (0, clean))
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(F.col("doc_id").cast("bigint"), tables.text_of().alias("text"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    before = F.sum(F.octet_length("text")).over(order) - F.octet_length("text")
    return rows.withColumn("before", before).where(F.col("before") < most_bytes).drop("before")


def fitted(sample: DataFrame) -> dict:
    """The model that ``train`` makes of a ``labelled_sample``, in one task."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort()
        model = train([(text, label) for _, label, text in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample.select("doc_id", "label", "text").repartition(1)
    made = rows.mapInArrow(run, "model BINARY").collect()
    return pickle.loads(made[0]["model"]) if made else train([])  # no rows, no task


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, windows and worst_word (first word of the worst window) of ``docs``.

    Every window of every whole text is scored, in the tasks that read the
    texts. A null or empty text is one empty window, scored as such; a null
    doc_id is kept; repeated rows score alike; further columns are ignored.
    windows counts the windows over all words, long ones cut; worst_word is a
    place among the words of the text as they are.
    """

    def run(batches):
        scorer = None if "constant" in model else Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n = part.num_rows
                if scorer is None:
                    best, counts, where = np.full(n, model["constant"]), np.zeros(n, int), np.zeros(n, int)
                else:
                    best, counts, where = scorer.texts(part.column(1).to_pylist())
                    slope, offset = model["calibration"]
                    best = 0.5 + 0.5 * np.tanh(0.5 * (slope * best + offset))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(best, pa.float64()),
                        pa.array(counts, pa.int64()),
                        pa.array(where, pa.int64()),
                    ],
                    names=["doc_id", "score", "windows", "worst_word"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), tables.text_of()).mapInArrow(run, SCORES)


def clean_documents(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns, unshuffled."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = None if "constant" in model else Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                if scorer is None:
                    keep = np.full(part.num_rows, model["constant"] < limit)
                else:
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    slope, offset = model["calibration"]
                    total = slope * scorer.texts(texts)[0] + offset
                    keep = 0.5 + 0.5 * np.tanh(0.5 * total) < limit
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
