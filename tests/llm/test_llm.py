"""The training-data operators on small tables: brute force, round trips and odd rows."""

import hashlib
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from spoolmark.llm import (
    bpe_automaton,
    chat_tree,
    components,
    exact_dedup,
    fingerprints,
    html_text,
    ngram_join,
    packing,
    quality,
    shingles,
    toxicity,
    url_filter,
)
from spoolmark.llm.subwords import ByteLevelTokens
from spoolmark.llm.tables import Workspace

tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    (1, "One two three four five six seven"),
    (2, "one  two\tthree four five six seven"),
    (3, None),
    (4, ""),
    (5, "a b"),
    (6, "A B"),
    (7, "word " * 30_000),
    (7, "word " * 30_000),
    (None, "one two three four five six seven"),
    (8, " leading  and <|endoftext|> inside\n Ünï 漢字 "),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id BIGINT, text STRING").withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_packing(odd, none):
    path = str(tokenizers.path("byte_bpe_50k.json"))
    made = packing.pack_documents(odd, path, length=64, segments=3, loss_tokens=60).collect()
    whole = ByteLevelTokens(path)
    ids = {}
    for doc, text in ODD:
        ids.setdefault(doc, []).append(whole._whole(text or "") + b"\0\0\0\0")
    found, sequences = {}, {}
    for r in made:
        found.setdefault(r.doc_id, []).append((r.start, bytes(r.token_ids)))
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, texts in ids.items():
        assert sum(len(b) for _, b in found[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(b for _, b in sorted(found[doc])) == texts[0]
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and len(r.token_ids) == 4 * r.length
            at += r.length
        assert at <= 64 and len(pieces) <= 3 and sum(r.loss_tokens for r in pieces) <= 60
    assert packing.pack_documents(none, path).count() == 0


def test_automaton_is_the_library(odd, none):
    path = str(tokenizers.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in bpe_automaton.encode_documents(odd.dropDuplicates(["doc_id"]), path).collect():
        text = dict(ODD)[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert array("I", r.token_ids).tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.encode_documents(none, path).count() == 0
    merges = [("a", "a"), ("aa", "b"), ("b", "c")]
    small = bpe_automaton.Automaton(list("abc"), merges, "")
    assert small.encode("aaaabc") == ["aa", "aab", "c"] and small.encode("aaabc") == ["aa", "a", "bc"]


def test_exact_dedup(spark, odd, tmp_path):
    folder = str(tmp_path / "docs")
    odd.repartition(3).write.parquet(folder)
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)):
        made = exact_dedup.deduplicate(spark, folder, digest).collect()
        assert len(made) == len(ODD)
        by = {}
        for r in made:
            by.setdefault(r.text_sha256, []).append(r)
        for rows in by.values():
            assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
        same = {r.doc_id: r.keep_id for r in made}
        assert same[3] == same[4] == 3 and same[5] == 5 and same[6] == 6 and same[1] == 1
        assert same[None] is same[2] or same[2] == 2
    empty = str(tmp_path / "empty")
    odd.limit(0).write.parquet(empty)
    assert exact_dedup.deduplicate(spark, empty).count() == 0


def _brute(rows, size, low):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    name = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if sets[i] and sets[j] and 100 * both >= low * either:
                    name[i] = name[j] = min(name[i], name[j])
    return [(rows[k][0], len(sets[k]), rows[name[k]][0]) for k in range(len(rows))]


def test_ngram_join(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        words = [f"w{x}" for x in np.random.default_rng(k // 12).integers(0, 50, 60)]
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            words[at] = "edited"
        rows.append((k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for small in (64, 2):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        made = [tuple(r) for r in ngram_join.near_duplicates(table, 3, 80).collect()]
        assert sorted(made) == sorted(_brute(rows, 3, 80))
    made = {(r[0], r[1]): r[2] for r in ngram_join.near_duplicates(odd, 3, 90).collect()}
    assert made[2, 5] == 1 and made[None, 5] == 1 and made[3, 0] == 3 and made[6, 1] == 5
    assert ngram_join.near_duplicates(none, 3, 90).count() == 0


def test_ngram_links(spark, odd, none):
    """All links of a family too large for one block, with copies, against brute force."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(96):
        words = [f"w{x}" for x in range(60)]
        for at in rng.integers(0, 60, k % 4):
            words[at] = f"edit{rng.integers(0, 9)}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for _, t in rows]
    linked = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    made = [tuple(r) for r in ngram_join.linked_documents(table, 3, 80).collect()]
    assert sorted(r[:3] for r in made) == sorted(_brute(rows, 3, 80))
    assert {r[0]: r[3] for r in made} == {k: sum(linked[k]) - 1 for k in range(96)}
    overlaps = sorted(r.overlap for r in ngram_join.links(table, 3, 80).collect())
    different = [s for k, s in enumerate(sets) if s not in sets[:k]]
    assert len(different) > ngram_join.SMALL
    assert overlaps == sorted(
        len(a & b) for i, a in enumerate(different) for b in different[:i]
        if 100 * len(a & b) >= 80 * len(a | b)
    )
    made = {(r.doc_id, r.n_shingles): r.n_links for r in ngram_join.linked_documents(odd, 3, 90).collect()}
    assert made[2, 5] == 2 and made[3, 0] == 0 and made[7, 1] == 1
    assert ngram_join.linked_documents(none, 3, 90).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(20)] + [(30, 31), (32, 31), (40, 40), (None, 1)]
    made = components.connected_components(
        spark.createDataFrame(links, "a BIGINT, b BIGINT"), Workspace(spark, "test")
    )
    found = dict(tuple(r) for r in made.collect())
    assert found == dict.fromkeys(range(21), 0) | {30: 30, 31: 30, 32: 30, 40: 40}


def test_chat_tree(spark):
    marks = "<|im_end|><|im_start|>assistant \\ok \\n<\\|"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", marks), (2, 0, "user", "hi"),
        (2, 1, "assistant", None), (3, 0, None, marks), (3, 0, "a\nb", "x\n"), (None, None, "assistant", "é"),
    ]
    table = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    segments = chat_tree.format_conversations(table, Workspace(spark, "test"))
    assert segments.where("text IS NULL").count() == 1
    made = {r.conv_id: r for r in chat_tree.read_back(segments).collect()}
    said = {1: [("user", "hi"), ("assistant", marks)], 2: [("user", "hi"), ("assistant", "")],
            3: [("", marks), ("a\nb", "x\n")], None: [("assistant", "é")]}
    for conv, rows in said.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in rows).encode()
        loss = "".join(t for r, t in rows if r == "assistant")
        assert made[conv].turns_sha256 == hashlib.sha256(whole).hexdigest()
        assert (made[conv].loss_chars, made[conv].n_turns) == (len(loss), len(rows))
        assert made[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_tree_shares_turns_at_any_depth(spark):
    """Deep branches with interleaved ids: every node is emitted once."""
    def talk(conv, *parts):
        said = [f"{name}{i}" for name, n in parts for i in range(n)]
        return [(conv, i, "user", text) for i, text in enumerate(said)]

    turns = []
    for conv in range(0, 12, 3):  # two branches below turn 32, and one that leaves at it
        turns += talk(conv, ("a", 32), ("b", 8), (f"x{conv}", 2))
        turns += talk(conv + 1, ("a", 32), (f"y{conv}", 3))
        turns += talk(conv + 2, ("a", 32), ("b", 8), ("c", 20 + conv), (f"z{conv}", 1))
    turns += talk(None, ("a", 32), ("b", 3))
    table = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    made = chat_tree.format_conversations(table, Workspace(spark, "test"))
    assert made.select("block").distinct().count() == 1 and made.count() == len(turns)
    emitted = made.where("text IS NOT NULL").count()
    assert emitted == made.select("node").distinct().count()
    back = {r.conv_id: r for r in chat_tree.read_back(made).collect()}
    for conv in {t[0] for t in turns}:
        whole = "".join(f"{r}\n{t}\n" for c, _, r, t in turns if c == conv)
        assert back[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_fingerprints(spark, none):
    rows = [(k, "".join(f"w{(k + i) % 97} " for i in range(5 * k))) for k in (9, 2, 5, 30)] + [(11, None)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    ordered = sorted((k, t or "") for k, t in rows)
    for parts in (1, 3, 8):
        made = {r.doc_id: r for r in fingerprints.fingerprint_documents(table, parts).collect()}
        for i, (doc, text) in enumerate(ordered):
            changed = fingerprints.edited(text, ordered[(i + 1) % len(ordered)][1])
            assert made[doc].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert made[doc].n_chars == len(text)
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_html(spark):
    nav = "one two three four five six seven eight nine ten"
    page = "<body><nav>menu</nav><div>{}</div><article><h1>T &amp; &lt;x</h1><p>a\n b<p>" + nav + "<div class='comments'>no</div></article><form>f</form>"
    rows = [(1, "http://h/1", page.format(nav + " own")), (2, "http://h/2", page.format(nav)),
            (3, None, None), (4, "http://h/4", "<p>plain <b>te</b>xt<script>x='</p>'</script>")]
    made = {r.page_id: r.text for r in html_text.main_texts(
        spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert made[1] == "own\nT & <x\na b\n" + nav and made[2] == "T & <x\na b\n" + nav
    assert made[3] == "" and made[4] == "plain text"


def test_html_repeats(spark):
    """Copies and shared quotations stay; menus of short blocks on most pages go."""
    menu = "".join(f"<div>item {x}</div>" for x in "abcde")
    foot = "<div>all rights</div><div>are reserved</div><div>here since</div><div>the year one</div>"
    quote = "to be or not to be that is the question indeed"
    body = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(12)]
    body[3] += " " + quote
    body[4] += " " + quote
    page = menu + "<div>{}</div><article>a{}</article>" + foot
    rows = [(k, f"http://many/{k}", page.format(body[k], k)) for k in range(12)]
    rows += [(100 + k, f"http://many/copy{k}", page.format(body[0], 0)) for k in range(9)]
    rows += [(200 + k, f"http://copies/{k}", f"<p>{quote}</p>") for k in range(3)]
    made = {r.page_id: r.text for r in html_text.main_texts(
        spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert len(made) == len(rows)
    for k in range(12):
        assert made[k] == f"{body[k]}\na{k}"
    assert {made[100 + k] for k in range(9)} == {f"{body[0]}\na0"}
    assert {made[200 + k] for k in range(3)} == {quote}


def test_html_names():
    """Names hide no page, main or article, and only as whole tokens."""
    def texts(page):
        return [t for kind, t in html_text.blocks_of(page) if kind != html_text.GONE]

    post = "<article class='post category-social'><div class='post-header'><h1>T</h1></div><p>x</p></article>"
    assert texts(f"<body class='home has-sidebar'><main id=search-results>{post}</main></body>") == ["T", "x"]
    assert texts(f"<body class=search><div class='wide search'>no{post}no</div><p>y") == ["T", "x", "y"]
    assert texts("<article><p data-id='ad' title='class=ad'>x</p><div class='big ad'>no</div>y</article>") == ["x", "y"]
    assert texts("<nav><article>no</article></nav><div role=navigation>no</div><p>a<span class=x-ad>b</span>c") == ["abc"]
    share = html_text.blocks_of("<article><div class=share-bar>s</div><p>x</p></article>")
    assert [k for k, _ in share] == [html_text.OPEN, html_text.KEEP]


def test_url_filter(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [(1, "https://A.Example.net/en/x?y#z", None), (2, "http://example.net/fr", None), (3, None, ""),
            (4, "http://plain.com/a", link.format("http://example.net/fr")), (5, "no scheme", ""),
            (6, "http://x.org/fr/1", link.format("http://plain.com/b")), (7, "http://plain.com/b", ""),
            (8, "http://plain.com/c", "<META HTTP-EQUIV=refresh content='0; url=/a'>")]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")]
    made = {r.page_id: r for r in url_filter.judge(
        spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), rules).collect()}
    assert [made[k].verdict for k in range(1, 9)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block"]
    assert (made[1].host, made[1].path, made[1].rule, made[4].rule) == ("a.example.net", "/en/x", "example.net/en/", None)


def test_models_on_held_out_rows(spark, odd):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    made = contract.queries()["op10_toxicity"](spark, sf_dir).collect()
    held = [r for r in made if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in made)
    assert sum(r.predicted == labels[r.doc_id].toxic for r in held) / len(held) > 0.97
    made = contract.queries()["op8_quality"](spark, sf_dir).collect()
    known = [r for r in made if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in known) / len(known) > 0.97
    constant = {"constant": 0.0}
    assert toxicity.score_documents(odd, constant).count() == len(ODD)
    assert quality.score_documents(odd, constant).count() == len(ODD)
    assert toxicity.train([]) == {"constant": 0.0}


def test_toxicity_reads_all_of_a_text():
    """Passages late in a word without spaces, and anywhere in a long training row."""
    rng = np.random.default_rng(5)
    plain = lambda n: [f"plain{x}" for x in rng.integers(0, 60, n)]
    bad = ["vile", "hateful", "filth", "scum"]
    rows = []
    for _ in range(12):  # the passage is outside any slice of 20,000 words but those at the start
        rows += [(" ".join([*plain(100), *bad, *plain(41_000)]), 1), (" ".join(plain(300)), 0)]
    model = toxicity.train(rows, rounds=30)
    scorer = toxicity.Scorer(model)
    joined = "_".join([*plain(50), *bad])
    texts = [" ".join(bad), joined, "_".join(plain(50)), f"plain1 plain2 {joined}"]
    best, windows, where = scorer.texts(texts)
    assert best[0] > 0 and best[1] > 0 > best[2] and best[3] > 0
    assert windows[1] > 1 and where[1] == 0 and where[3] == 2
    run = "".join(chr(0x4E00 + k) for k in range(500))
    pieces = toxicity.words_of(f"{run} ab")[0]
    assert pieces[-1] == "ab" and all(run[k : k + 4] in " ".join(pieces) for k in range(497))
    assert toxicity.words_of("a" * 40)[0] == ["a" * 40]


def _areas(spark, name, label, positive, sf):
    """Rows, rows of the class and those caught, false alarms, and the area under the curve."""
    sf_dir = f"/root/testdata/sf{sf}"
    made = contract.queries()[name](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"
    )
    rows = [r for r in made.collect() if "held_out" not in made.columns or r.held_out]
    of = np.array([r[label] == positive for r in rows])
    got = np.array([r.predicted == positive for r in rows])
    score = np.array([r.score if positive else -r.score for r in rows])
    better = (score[of][:, None] > score[~of]) + 0.5 * (score[of][:, None] == score[~of])
    return int(of.sum()), int((got & of).sum()), int((got & ~of).sum()), float(better.mean())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_quality_finds_bad_texts_in_small_tables(spark, sf):
    bad, caught, false, area = _areas(spark, "op8_quality", "quality", 0, sf)
    assert caught >= 0.95 * bad and false <= 2 and area > 0.95


def test_quality_one_kind_of_bad_text_each():
    """Bad texts that one labeller finds each, beside a few that two agree on."""
    n = len(quality.LABELLERS)
    one = {"g" * k + "b" + "g" * (n - k - 1): 12 for k in (0, 2, 7)}
    counts = {"g" * n: 900, "gbggb" + "g" * (n - 5): 20, **one}
    posterior, _ = quality.estimate(counts)
    assert posterior["g" * n] > 0.5 and all(posterior[p] < 0.5 for p in counts if p != "g" * n)


def test_quality_reads_whole_words():
    left, right = ("a" * 45 + middle + "xyz" for middle in "bc")
    assert quality._features(left) != quality._features(right)


def test_toxicity_in_a_small_table(spark):
    toxic, caught, false, area = _areas(spark, "op10_toxicity", "toxic", 1, "0.01")
    assert caught >= toxic / 2 and false <= 5 and area > 0.75


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100, 1) for k in range(200)], "doc_id BIGINT, text STRING, label INT")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    sizes = dict(
        toxicity.labelled_sample(docs, labels, most_bytes=950).groupBy("label").count().collect()
    )
    assert sizes == {0: 10, 1: 10}
    assert toxicity.fitted(toxicity.labelled_sample(docs, labels.limit(0))) == {"constant": 0.0}


def _row_names(docs):
    """The frame with further columns that carry names used inside the stages."""
    for name in ("digest", "points", "kept_id", "gone", "row", "id", "name", "node", "component"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_words_of_regular_build_differ(spark):
    """Two different words of 1,024 letters that polynomials modulo 2^64 hash alike."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    a, b = (shingles.word_hashes(t.encode())[0] for t in (one, two))
    assert a != b
    table = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id BIGINT, text STRING")
    made = sorted(tuple(r) for r in ngram_join.near_duplicates(table, 3, 90).collect())
    assert made == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    words = ["Ab", "ab", "ba", "abab", "b" * 5000, "x"]
    by_one = [int(shingles.word_hashes(w.encode())[0]) for w in words]
    assert by_one[0] == by_one[1] and len(set(by_one)) == 5
    at_once = [int(h) for h in shingles.word_hashes("  \t".join([""] + words).encode())]
    assert at_once == by_one


def test_ngram_chains_and_families(spark):
    """Chains whose ends do not link, and families that share buckets, against brute force."""
    rng = np.random.default_rng(8)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(90)]
        for k in range(40):
            words[(k * 2) % 90] = f"step{chain}x{k}"
            rows.append((len(rows), " ".join(words)))
    shared = [f"s{k}" for k in range(40)]
    for k in range(80):
        own = [f"f{k % 5}w{j}" for j in range(25)]
        own[rng.integers(0, 25)] = f"e{rng.integers(0, 4)}"
        rows.append((1000 + k, " ".join(shared + own)))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    made = sorted(tuple(r) for r in ngram_join.near_duplicates(table, 3, 80).collect())
    assert made == sorted(_brute(rows, 3, 80))


def test_ngram_numbers_that_clash(spark, monkeypatch):
    """Differing sets with one first number go by their second."""
    whole = ngram_join._nodes

    def few(sets):
        node, check = whole(sets)
        return [None if n is None else n % 3 for n in node], check

    monkeypatch.setattr(ngram_join, "_nodes", few)
    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t u v w x y {'z' * (k % 9)}") for k in range(30)]
    rows += [(30 + k, f"t{k} u v w") for k in range(10)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    made = sorted(tuple(r) for r in ngram_join.near_duplicates(table, 3, 80).collect())
    assert made == sorted(_brute(rows, 3, 80))


def test_one_of_each_row_by_row(spark, odd, none):
    """Rows that share an id are judged on their own; names of columns may clash."""
    text = "one two three four five six seven eight nine ten"
    other = "eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, text), (7, text), (7, other), (7, other), (8, " \t"), (8, None), (None, other), (None, "x y z")]
    docs = _row_names(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    made = ngram_join.one_of_each(docs, 5, 80)
    assert made.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in made.collect()), key=str)
    assert left == sorted([(1, text), (7, other), (8, " \t"), (8, None), (None, "x y z")], key=str)
    assert ngram_join.one_of_each(none, 5, 80).count() == 0


def test_distinct_documents_row_by_row(spark, none, tmp_path):
    rows = [(1, "A b"), (7, "A  b"), (7, "C"), (7, "C"), (2, "C"), (8, " "), (9, None), (None, "C"), (None, "d")]
    docs = _row_names(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    docs.write.parquet(str(tmp_path / "docs"))
    made = exact_dedup.distinct_documents(spark.read.parquet(str(tmp_path / "docs")))
    assert made.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in made.collect()), key=str)
    assert left == sorted([(7, "A  b"), (2, "C"), (8, " "), (None, "d")], key=str)
    none.write.parquet(str(tmp_path / "none"))
    assert exact_dedup.distinct_documents(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_ngram_long_texts(spark):
    """Long texts that share much and do not link, and such that do, against brute force."""
    rng = np.random.default_rng(9)
    rows = []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(1500)]
        for k in range(10):
            own = list(words)
            for at in rng.integers(0, 1500, (k % 5) * 20):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    shared = [f"s{k}" for k in range(1200)]
    for k in range(10):
        rows.append((len(rows), " ".join(shared + [f"o{k}x{j}" for j in range(400)])))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    made = sorted(tuple(r) for r in ngram_join.near_duplicates(table, 3, 80).collect())
    assert made == sorted(_brute(rows, 3, 80))
    assert 4 < len({r[2] for r in made}) < 40


@pytest.mark.parametrize("low", [80, 90, 97])
def test_ngram_parts_of_linked_sets_meet(low):
    """Sets at the least similarity that links share a part, whatever their sizes and frequent hashes."""
    rng = np.random.default_rng(low)
    for n in [*range(1, 40), *rng.integers(40, 6000, 60)]:
        n = int(n)
        for m in {n, int(100 * n // low), int(rng.integers(n, 100 * n // low + 1))}:
            both = -(-low * (n + m) // (100 + low))
            assert both <= n and 100 * both >= low * (n + m - both)
            all_of = np.unique(rng.integers(0, 2**64, n + m - both, dtype=np.uint64))
            rng.shuffle(all_of)
            one, other = all_of[:n], np.concatenate((all_of[:both], all_of[n:]))
            names = []
            for side in (one, other):
                often = side % np.uint64(3) == 0
                hashes = np.concatenate((side[~often], side[often]))
                names.append({int(x) for found, _ in ngram_join._parts(hashes, int(often.sum()), low) for x in found})
            assert names[0] & names[1]


def test_ngram_by_parts(spark, monkeypatch):
    """Families on both sides of the size from which sets meet by parts, against brute force."""
    monkeypatch.setattr(ngram_join, "LONG", 40)
    rng = np.random.default_rng(12)
    rows = []
    for family in range(6):
        words = [f"f{family % 3}w{k}" for k in range(36 + 4 * family)]
        for k in range(12):
            own = words + [f"more{k % 4}x{j}" for j in range(k % 5)]
            for at in rng.integers(0, len(words), k % 3):
                own[at] = f"e{rng.integers(0, 3)}"
            rows.append((len(rows), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    made = sorted(tuple(r) for r in ngram_join.near_duplicates(table, 3, 80).collect())
    assert made == sorted(_brute(rows, 3, 80))
    overlaps = ngram_join.links(table, 3, 80).count()
    sets = {frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)}
    assert 2 * overlaps == sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for a in sets for b in sets)


def test_ngram_long_texts_of_common_passages(spark):
    """Long texts dealt from one store of sentences share many shingles; the join pairs hardly any."""
    rng = np.random.default_rng(13)
    store = [" ".join(f"w{x}" for x in rng.integers(0, 400, 12)) for _ in range(1500)]
    rows = [(k, " ".join(store[x] for x in rng.permutation(1500)[:250])) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    _, met, _ = ngram_join._met(table, 3, 90, Workspace(spark, "long-texts"))
    assert ngram_join._with_others(met.withColumn("component", F.col("node")), 90).count() < 60
    assert [r.component_id for r in ngram_join.near_duplicates(table, 3, 90).orderBy("doc_id").collect()] == list(range(60))


def test_memory_of_a_worker():
    """Slices of long texts and remembered words take a bounded, small part of an executor."""
    import sys
    import tracemalloc

    text = b" ".join(b"w%d" % k for k in range(150_000))
    tracemalloc.start()
    hashes = shingles.word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 150_000 and peak < 32 << 20
    tokens = ByteLevelTokens(str(tokenizers.path("byte_bpe_50k.json")))
    most = 0
    for start in range(0, 400_000, 50_000):
        words = [f"w{k}x" for k in range(start, start + 50_000)]
        assert len(tokens.ids(" ".join(words))) >= 4 * len(words)
        held = [*tokens.known.items()]
        most = max(most, sys.getsizeof(tokens.known) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held))
    assert 0 < most < 40 << 20
    assert tokens.ids("w1x and w1x") == tokens._whole("w1x and w1x")


def test_stages_exchange_small_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def seen(spark, docs, _):
        def sizes(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

        return docs.mapInArrow(sizes, "id BIGINT")

    try:
        stage = corpus_pipeline.in_small_batches(seen)
        sizes = [r.id for r in stage(spark, spark.range(0, 2500, 1, 1), "").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 2500 and max(sizes) == corpus_pipeline.BATCH_ROWS
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
