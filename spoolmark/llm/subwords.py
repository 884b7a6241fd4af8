"""Token ids of a byte-level tokenizer file, with a bounded memory of word pieces."""

from __future__ import annotations

import json
import re
import sys
from array import array

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REMEMBERED = 200_000  # about 30 MB of a Python worker; most runs are seen once

#: How the byte-level pre-tokenizer splits (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def worker_cache() -> dict:
    """Kept by a Python worker from one task to the next; holds what is compiled from files."""
    return sys.__dict__.setdefault("_spoolmark_worker_cache", {})


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Remembered(dict):
    """A function's results, forgotten all at once when there are too many."""

    def __init__(self, function, most: int = REMEMBERED) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


class ByteLevelTokens:
    """Ids as the tokenizers library gives them with add_special_tokens=False.

    The library splits a text before it merges, and never inside a run that
    starts at a lone space between two other characters. So a text is cut at
    such spaces, and the ids of each run are remembered. Texts in which a
    space stands beside another blank are encoded whole by the library. New
    runs of Latin letters go to a faster encoder of the same merges.
    """

    _beside = re.compile(r"\s |\s\Z| (?=\s)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._same_merges(path)
        self.known = Remembered(self._run)

    @classmethod
    def of(cls, path: str) -> ByteLevelTokens:
        cache = worker_cache()
        if ("byte level", path) not in cache:
            cache["byte level", path] = cls(path)
        return cache["byte level", path]

    @staticmethod
    def _same_merges(path: str):
        """An encoder whose ranks are the ids, if the file numbers its merges in order."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items()}
        return tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if self.fast and max(run, default="") < "\u0250":
            return array("I", self.fast(run)).tobytes()
        return self._whole(run)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if self._beside.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self.known
        return b"".join([known[first], *[known[" " + word] for word in rest]])
