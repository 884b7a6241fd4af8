"""Prefix trie and source divergence against plain loops, on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spoolmark.llm import divergence, prefix_trie
from spoolmark.llm.tables import Workspace

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def trie_of(rows):
    """Nodes by brute force."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        first = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        whole[conv] = tuple(own.get(first, [])[:h] + own[conv][h:])
    members = defaultdict(set)
    for conv, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(conv)
    children = Counter(p[:-1] for p in members if p)
    made = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == path)))
        made.append(
            (
                min(convs),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(convs),
                children[path],
                sum(not children[p] for p in under),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(made, key=str)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(-7, n):
        for turn in range(rng.choice((1, 2, 4, 12))):
            rows.append((conv, turn, rng.choice(("user", None)), rng.choice(("hé", "", None, "a", "b"))))
    rows += [(3, None, "user", "null turn"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "user", "x")]
    rows += [(1000 + k, 0, "user", "same") for k in range(60)]
    rows.append((2005, 0, "user", "long " * 50_000))
    return rows


@pytest.mark.parametrize("cells", [1 << 25, 64, 2])
def test_trie_equals_brute_force(spark, cells):
    rows = random_turns(4, 40)
    table = spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("clash")).withColumn("depth", F.lit(1))
    made = prefix_trie.build_trie(table, Workspace(spark, "trie"), max_cells=cells)
    assert sorted((tuple(r) for r in made.collect()), key=str) == trie_of(rows)


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    ids = [-20, -3, 0, 5, 6, 7, 99, 100_000]
    ends = spark.createDataFrame([("n", c) for c in ids] + [("m", 1)], "node STRING, conv_id BIGINT")
    assert dict(tuple(r) for r in prefix_trie.list_digests(ends).collect()) == {
        "n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        "m": hashlib.sha256(b"1").hexdigest(),
    }


def test_sketch_never_clears_a_shared_prefix(spark):
    turns = prefix_trie.turns_in_order(spark.createDataFrame(random_turns(9, 60), TURNS))
    rows = prefix_trie.prefixes(*prefix_trie.rebuilt(turns))
    for cells in (16, 1 << 20):
        flagged = prefix_trie.screened(rows, cells).select("node", "shared").collect()
        count = Counter(r["node"] for r in flagged)
        assert all(r["shared"] for r in flagged if count[r["node"]] > 1)
    # A roomy sketch clears singletons, so that few rows are grouped.
    assert sum(not r["shared"] for r in flagged) > 0.9 * sum(n == 1 for n in count.values())


def test_trie_of_turnless_and_empty(spark):
    # 9 has its only turn before the place where its own begin, and no first of its family.
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    table = spark.createDataFrame([(lone, 0, "user", "x")], TURNS)
    made = prefix_trie.build_trie(table, Workspace(spark, "trie")).collect()
    assert [tuple(r)[:7] for r in made] == [(lone, 0, None, 1, 0, 1, 0)]
    assert made[0]["ends_sha256"] == hashlib.sha256(str(lone).encode()).hexdigest()
    assert prefix_trie.build_trie(table.limit(0), Workspace(spark, "trie")).count() == 0


DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING"


def audit(rows, least, top):
    docs = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for _, text, lang, source in rows
    ]
    made = []
    for lang in {d[0] for d in docs}:
        seen, count, total = Counter(), defaultdict(Counter), Counter()
        for of, source, words in docs:
            if of == lang:
                seen.update(set(words))
                count[source].update(words)
        kept = sorted(t for t in seen if seen[t] >= least)
        for source in count:
            count[source] = Counter({t: count[source][t] for t in kept if count[source][t]})
            total += count[source]

        def rate(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for source, c in count.items():
            pairs = [(sum(abs(rate(c, t) - rate(o, t)) for t in kept), s) for s, o in count.items() if s != source]
            terms = [(rate(c, t) - rate(total, t), t) for t in kept if c[t] and rate(c, t) > rate(total, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                made += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(made)


@pytest.mark.parametrize("block", [64, 2])
def test_divergence_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(block)
    words = ["Le", "le", "LES", "été", "ÉTÉ", "漢字", "ab", "abc", "abcd", "a" * 40, "a" * 41, "ab1cd", "ß-x", " y\u0085z", "😀q"]
    rows = [
        (k, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(("en", "fr", None)), rng.choice(("s1", "s2", "s3", "é", None)))
        for k in range(80)
    ]
    rows += [(1, None, "en", "empty"), (1, None, "en", "empty"), (None, "12 !", "xx", "a"), (5, "le " * 20_000, "xx", "b")]
    table = spark.createDataFrame(rows, DOCS).withColumn("terms", F.lit("clash")).withColumn("prefix", F.lit(0))
    for first in (1, 3, 64):
        made = divergence.audit_sources(table, Workspace(spark, "audit"), min_docs=10, top=4, first=first)
        assert sorted(tuple(r) for r in made.collect()) == audit(rows, 10, 4)
    assert divergence.audit_sources(table.limit(0), Workspace(spark, "audit")).count() == 0
