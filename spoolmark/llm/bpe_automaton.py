"""Byte-pair encoding by a deterministic automaton over token labels.

The automaton accepts exactly those token sequences that the merges make. It
starts as one state with an arc for every base symbol. Each merge (u, v) -> w,
in order of rank, adds one gadget: wherever an arc u leads to a state p that
has an arc v, the arc u now leads to a copy of p without the arc v, and an arc
w leads to where v led from p. All arcs of one label lead to one state, so a
gadget adds one state for each merge. A copy is stored as what it lacks: the
arc removed and the rank of its gadget; the origin follows from the label. An
arc made later exists in the copy exactly if the arc of its left part did then.

A pre-split word is encoded by transitions along its characters: the word's
prefix of each length has one accepted token sequence, and the state after it
has an arc for just one of the tokens that end the next prefix. Whether a state
has an arc is looked up in its table, which fills as arcs are first asked for.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolmark.llm import tables
from spoolmark.llm.subwords import Remembered, byte_letters, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENCODED = "doc_id BIGINT, n_tokens BIGINT, token_ids BINARY, decoded STRING"


class Automaton:
    """Compiled merges. ``alphabet`` are base symbols, each one letter or one letter
    and ``suffix``; ``merges`` are pairs in order of rank."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.parts: dict[str, tuple[str, str] | None] = dict.fromkeys(alphabet)
        self.born = dict.fromkeys(alphabet, -1)  # rank of the gadget that made the arc
        self.removed: dict[str, dict[str, int]] = {}  # by state: label without arc, since
        for rank, (u, v) in enumerate(merges):
            if u in self.born and v in self.born and u + v not in self.born and self._arc(u, v):
                self.removed.setdefault(u, {})[v] = rank
                self.parts[u + v], self.born[u + v] = (u, v), rank
        # Whether a run of letters is a label or just begins one.
        self.known: dict[str, bool] = {}
        for label in self.parts:
            for k in range(1, len(label)):
                self.known.setdefault(label[:k], False)
            self.known[label] = True
        self._tables: dict[str, dict[str, bool]] = {}
        self.openings = Remembered(self._openings, 200_000)

    def _arc(self, state: str, label: str) -> bool:
        """Whether the state after ``state`` has the arc ``label``.

        A state lacks what its own gadgets removed, and what had been removed
        from the state after its right part when the label was made. An arc is
        missing if it was removed, or its left part before the arc was made.
        """
        lefts, limit = [], float("inf")
        at = label
        while True:
            lefts.append((at, limit))
            limit, parts = self.born[at], self.parts[at]
            if parts is None:
                break
            at = parts[0]
        limit = float("inf")
        while True:
            gone = self.removed.get(state)
            if gone:
                for at, by in lefts:
                    rank = gone.get(at)
                    if rank is not None and rank < limit and rank <= by:
                        return False
            limit, parts = self.born[state], self.parts[state]
            if parts is None:
                return True
            state = parts[1]

    def has_arc(self, state: str, label: str) -> bool:
        """Looks the arc up in the state's table; "" is the start, with every arc."""
        if not state:
            return True
        table = self._tables.get(state)
        if table is None:
            table = self._tables[state] = {}
        answer = table.get(label)
        if answer is None:
            answer = table[label] = self._arc(state, label)
        return answer

    def encode(self, word: str) -> list[str]:
        """The accepted labels that spell ``word`` and the suffix.

        Follows the longest arc first. The sequence that spells a prefix is
        unique, so a place from which the word can't be finished is left for good.
        """
        whole, n, known, tables = word + self.suffix, len(word), self.known, self._tables
        if known.get(whole):
            return [whole]
        out: list[str] = []
        waiting: list = []  # shorter labels to try, by depth
        begin, before, dead, choices = 0, "", None, None
        while True:
            if choices is None:
                label = whole[begin:]
                if known.get(label) and self.has_arc(before, label):
                    out.append(label)
                    return out
                labels, more = self.openings[word[begin : begin + 4]]
                if more:
                    labels = self._longer(word, begin, labels)
                choices = iter(labels)
            for label in choices:
                if begin + len(label) == n or dead and begin + len(label) in dead:
                    continue
                # The table of the state, read in place.
                arc = tables[before].get(label) if before in tables else None
                if arc or arc is None and self.has_arc(before, label):
                    waiting.append(choices)
                    out.append(label)
                    begin += len(label)
                    before, choices = label, None
                    break
            else:
                if not out:
                    raise ValueError(f"no accepted labels for {word!r}")
                dead = dead or set()
                dead.add(begin)
                choices = waiting.pop()
                begin -= len(out.pop())
                before = out[-1] if out else ""

    def _openings(self, letters: str) -> tuple[list[str], bool]:
        """Labels that begin ``letters``, longest first; whether longer ones may follow."""
        labels: list[str] = []
        for end in range(1, len(letters) + 1):
            kind = self.known.get(letters[:end])
            if kind is None:
                return labels, False
            if kind:
                labels.insert(0, letters[:end])
        return labels, len(letters) == 4

    def _longer(self, word: str, begin: int, labels: list[str]) -> list[str]:
        longer: list[str] = []
        for end in range(begin + 5, len(word)):
            kind = self.known.get(word[begin:end])
            if kind is None:
                break
            if kind:
                longer.insert(0, word[begin:end])
        return longer + labels if longer else labels


class WordTokens:
    """Encodes and decodes with a tokenizer file whose merges mark the ends of words.

    Normalised and split as the file says (canonical composition, blanks to one
    space, lower case; contractions, letters, single digits and other runs).
    None of that reaches across a space, so the ids of a run between spaces are
    remembered. Special tokens inside a text keep their own ids.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids_of = model["vocab"]
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        size = max([*self.ids_of.values(), *self.special.values()]) + 1
        self.labels = [""] * size
        for label, i in [*self.ids_of.items(), *self.special.items()]:
            self.labels[i] = label
        letters = list(byte_letters())
        self.letter = {b: c for c, b in byte_letters().items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        alphabet = list(dict.fromkeys(letters + [c + self.end for c in letters]))
        self.automaton = Automaton(alphabet, pairs, self.end)
        self.normal = library.normalizer.normalize_str
        pattern = stated["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = Remembered(self._word, 500_000)
        self.runs = Remembered(self._run, 600_000)

    @classmethod
    def of(cls, path: str) -> WordTokens:
        cache = worker_cache()
        if ("words", path) not in cache:
            cache["words", path] = cls(path)
        return cache["words", path]

    def _word(self, word: str) -> bytes:
        labels = self.automaton.encode("".join(map(self.letter.__getitem__, word.encode())))
        return array("I", map(self.ids_of.__getitem__, labels)).tobytes()

    def _plain(self, text: str) -> bytes:
        lower = text.lower() if text.isascii() else self.normal(text)
        return b"".join(map(self.words.__getitem__, self.split(lower)))

    def _run(self, run: str) -> bytes:
        lower = run.lower()
        word = lower.rstrip(".,")
        if word.isalpha() and max(run) < "\u0250" and word.isprintable():
            # One word of composed Latin letters, with what follows it.
            rest = lower[len(word) :]
            return self.words[word] + self.words[rest] if rest else self.words[word]
        if "<|" not in run:
            return self._plain(run)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            for part in self.cut.split(run)
        )

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return b"".join(map(self.runs.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        """The arc labels with a space between, as a file without a decoder is decoded."""
        return " ".join(map(self.labels.__getitem__, array("I", ids)))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and their decoding for the whole text of each of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    Returns doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and
    decoded, one row per row of ``docs``; nothing is shuffled, and what a
    worker remembers is bounded. A null or empty text has no ids and decodes
    to an empty text; a null doc_id is kept; further columns are ignored.
    """

    def run(batches):
        tokens = WordTokens.of(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = [tokens.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([tokens.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), tables.text_of()).mapInArrow(run, ENCODED)
