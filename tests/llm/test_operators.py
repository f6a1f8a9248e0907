"""Each numbered operator against a brute-force version or a round trip, and on nulls, empty tables, repeated rows and clashing names."""

import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roundlens.llm import chat_format as C
from roundlens.llm import components, decontaminate, embed_dedup, html_template, jaccard_join, piece_codec, quality, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def test_token_counts_match_greedy_longest_match(spark):
    vocabulary = json.load(open(token_counts.VOCABULARY))["model"]["vocab"]
    show = {b: c for c, b in token_counts.byte_symbols().items()}

    def greedy(word):
        symbols, n, i = [show[b] for b in word.encode()], 0, 0
        symbols[-1] += "</w>"
        while i < len(symbols):
            i = next(j for j in range(len(symbols), i, -1) if "".join(symbols[i:j]) in vocabulary)
            n += 1
        return n

    texts = ["Hello worldly unbelievables!!", "", None, "naïve Ümlaut 漢字 12x" * 3, "x" * 5000, "  \n\t "]
    got = token_counts.token_counts(docs(spark, texts).withColumn("N_Tokens", F.lit("clash"))).orderBy("doc_id").collect()
    pattern, _ = token_counts.load(token_counts.VOCABULARY)
    for row, text in zip(got, texts):
        words = pattern.findall((text or "").lower())
        assert (row.n_words, row.n_tokens) == (len(words), sum(map(greedy, words)))
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def test_longest_match_automaton_on_small_vocabularies():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {("a",), ("b",), ("c",)} | {tuple(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(0, 8))}
        automaton = token_counts.LongestMatch(list(pieces))
        word = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        n = i = 0
        while i < len(word):
            i = next(j for j in range(len(word), i, -1) if tuple(word[i:j]) in pieces)
            n += 1
        assert automaton.count(word) == n


def test_pieces_equal_the_library_and_come_back(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_codec.MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abthe  ▁\n\t漢é\x01.,'ing▁▁    xqu1279") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, " ", "word " * 4000]
    out = piece_codec.decode_pieces(piece_codec.encode_pieces(docs(spark, texts))).orderBy("doc_id").collect()
    for row, text in zip(out, texts):
        assert row.token_ids == library.encode(text or "") and row.n_tokens == len(row.token_ids)
        assert row.roundtrip and row.decoded == (text or "").replace("▁", " ")


def test_unigram_pass_equals_all_cuts():
    """The best total score over every way to cut a word into pieces."""
    model = object.__new__(piece_codec.PieceModel)
    rng = random.Random(13)
    model.unigram, model.memo, model.memo_chars, model.byte_ids, model.unknown = True, {}, 0, {}, 99
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} | set("abc"))
    model.ids = {p: i for i, p in enumerate(names)}
    model.score = {p: -rng.uniform(1, 4) * len(p) ** 0.7 for p in names}
    model.tails = {p[k:]: -1 for p in names for k in range(len(p))} | model.ids
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    model.encode_words(words)

    def best(word):
        return max((model.score[word[:k]] + (best(word[k:]) if k < len(word) else 0) for k in range(1, len(word) + 1) if word[:k] in model.score), default=-1e9)

    for word in words:
        assert "".join(names[i] for i in model.memo[word]) == word
        assert abs(sum(model.score[names[i]] for i in model.memo[word]) - best(word)) < 1e-9


def test_html_extraction(spark):
    frame = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav>{}<footer>&copy; 1</footer></body></html>'
    article = '<article><h1>One &amp; two</h1><p>a\n  b<br>c<p>d<div class="comments"><p>no</p></div><script>x="</p>"</script><form>no</form></article>'
    pages = [
        (1, "http://a.example/1", frame.format(article)),
        (2, "http://a.example/2", frame.format('<div class="sidebar">no</div><article><p>only</p></article><aside>no</aside>')),
        (3, None, None),
        (4, "x", "plain &lt;b&gt; text"),
        (5, "http://b.example/", "<article><p>cut &am"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_template.extract_main_text(df).collect()}
    want = {1: "One & two\n\na b c\n\nd", 2: "only", 3: "", 4: "plain <b> text", 5: "cut &am"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def test_template_drops_text_common_to_a_host(spark):
    pages = [(i, f"http://h.example/{i}", f'<html><body><div class="c"><p>Always the same line</p><p>body {i} {"w" * (i % 7 + 9)}</p></div></body></html>') for i in range(40)]
    got = html_template.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f'body {i} {"w" * (i % 7 + 9)}' for i in range(40)}


@pytest.mark.parametrize("text", ["", "a", "<|im_end|>", "<\\|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<<|im_end|>|im_start|>", "\\<|im_end|", None])
@pytest.mark.parametrize("role", ["user", "assistant", None, "a\nb", "<|im_end|>", "\\n"])
def test_chat_turns_come_back(role, text):
    assert C.parse(C.format_turn(role, text)) == [(role or "", text or "")]


def test_chat_conversations(spark):
    rows = [(1, 1, "assistant", "hi<|im_end|>"), (1, 0, "user", "yo"), (None, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", None)]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 12 and got[2].n_turns == 2 and got[None].n_turns == 1
    from hashlib import sha256

    assert got[1].turns_sha256 == sha256(b"user\nyo\nassistant\nhi<|im_end|>\n").hexdigest()
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (3, 12, 40, 150)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(20)] + [f"{' '.join(word() for _ in range(77))} {items[i]} {' '.join(word() for _ in range(90))}" for i in range(4)] + [None, "", items[1].upper()]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs(spark, texts), bench).collect()}
    assert got == {(20, 0), (21, 1), (22, 2), (23, 3), (26, 1)}
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns and kept.count() == len(texts) - 5
    assert decontaminate.benchmark_matches(docs(spark, texts), bench.limit(0)).count() == 0


def test_block_max_search_equals_brute_force():
    """All passages against all parts, scored without an index."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([2, 9, 30, 64, 150])))) for k in range(90)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(25)] + [f"a b {items[k][1]} c" for k in range(12)]
    shard = decontaminate.build_shard(items)
    parts = [p for _, t in items for p in np.array_split(np.array(t.split()), -(-len(t.split()) // decontaminate.PART_WORDS))]
    length = sum(map(len, parts)) / len(parts)
    df = {w: sum(w in p for p in parts) for w in words}

    def weights(p):
        tf = {w: int((p == w).sum()) for w in p}
        raw = {w: np.log1p((len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / length)) for w, n in tf.items()}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    weight = [weights(p) for p in parts]
    reached = 0
    for text in texts:
        held = text.split()
        h = decontaminate.word_hashes([text])[0]
        lo = np.arange(0, max(len(h), 1), decontaminate.PART_WORDS)
        hi = np.minimum(lo + 2 * decontaminate.PART_WORDS, len(h))
        got = {(p, k): s for p, k, s in decontaminate.passages_found(shard, h, lo, hi)}
        want = {(i, k): sum(x for w, x in weight[k].items() if w in set(held[a:b])) for i, (a, b) in enumerate(zip(lo, hi)) for k in range(len(parts))}
        want = {key: x for key, x in want.items() if x >= decontaminate.THRESHOLD}
        assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-4 for key in want)
        reached += len(want)
    assert reached > 12


def test_decontamination_edges(spark, monkeypatch):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = [word() for _ in range(220)]
    item = [word() for _ in range(24)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item)), (3, " ".join(item)), (3, "x y"), (None, "a b c")], "item_id long, text string")
    rows = [
        (1, " ".join([word() for _ in range(90)] + long + [word() for _ in range(70)])),
        (2, " ".join([word() for _ in range(9)] + long[:150])),  # the question alone
        (3, " ".join(long[166:])),  # the answer alone
        (4, " ".join(item)), (4, " ".join(item)), (None, " ".join(item)), (6, ""), (7, None), (8, " ".join([word() for _ in range(60_000)] + item)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("benchmark_hits", "_row", "benchmark_hits_0", "_c1"):
        df = df.withColumn(name, F.lit("mine"))
    want = sorted([(1, 1), *[(d, k) for d in (4, 4, None, 8) for k in (2, 3)]], key=str)
    for most in (1_000_000, 150):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", most)
        assert sorted(((r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(df, bench).collect()), key=str) == want
        kept = decontaminate.drop_contaminated(df, bench)
        assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {("mine",) * 4} and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7]
    assert decontaminate.benchmark_matches(df.limit(0), bench).count() == 0


def brute_components(sets, linked):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def family(rng, n):
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("star", "most", "tile"), [(256, 1_000_000, 1 << 16), (10, 300, 16), (10, 1_000_000, 1 << 16)])
def test_jaccard_components(spark, monkeypatch, star, most, tile):
    for name, value in (("STAR", star), ("GROUP_MOST", most), ("TILE", tile), ("FREQUENT", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(2)
    texts = family(rng, 40) + family(rng, 25) + ["same text here"] * 3 + ["a b", "A\tb", "", None, " \n", "one"] + [" ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = brute_components(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_groups_span_batches(spark):
    """A group's sets and pairs may come in any number of Arrow batches."""
    rng = random.Random(17)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    texts = []
    for i in range(12):
        words = base[:]
        words[7 * i % 90] = f"x{i}"
        texts.append(" ".join(words))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [r.component_id for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [0] * 12


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e f", "x", "y", 1), (5, "a b c d e f", "x", "y", 1), (5, "a b c d e f", "x", "y", 1), (3, "a b c d e f", None, None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (None, None)]
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [3, None]


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 12, (30, 32))
    point = np.concatenate([np.maximum(0, base[rng.integers(0, 30, 300)] + rng.integers(-1, 2, (300, 32))), rng.integers(0, 12, (200, 32))]).astype(np.int32)
    n = point.sum(1)
    tree = jaccard_join.CountTree(n, point)
    for i in range(0, 500, 7):
        ok = (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i])) & (180 * np.minimum(point, point[i]).sum(1) >= 80 * (n + n[i]))
        assert set(tree.search(n[i], point[i])) == set(np.flatnonzero(ok))


@pytest.mark.parametrize(("edges_a_task", "broadcast", "hot"), [(200_000, 500_000, 100_000), (20, 500_000, 100_000), (20, 0, 3)])
def test_components(spark, monkeypatch, edges_a_task, broadcast, hot):
    for name, value in (("EDGES_A_TASK", edges_a_task), ("BROADCAST_NODES", broadcast), ("HOT", hot)):
        monkeypatch.setattr(components, name, value)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges + [(None, 1), (7, 7)], "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [512, 8])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.06 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(90)]
    rows += [(100 + i, rows[0][1], 0) for i in range(4)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [float("inf")] * 16, 1), (204, rows[0][1], None), (205, [], 0), (206, [None] + [1.0] * 15, 0), (207, [1.0, 2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    linked = lambda a, b: label[a] == label[b] and float(unit[a] @ unit[b]) >= 0.98
    want = brute_components(unit, linked)
    links = {i: sum(linked(i, j) for j in unit if j != i) for i in unit}
    found = sum(got[i][0] for i in unit)
    assert 0.95 * sum(links.values()) <= found <= sum(links.values())
    assert sum(got[i][1] == want[i] for i in unit) >= 0.95 * len(unit)
    assert all(got[i] == (0, i, True) for i, _, _ in odd)


def test_near_vectors_of_repeated_ids(spark):
    """A node is an id: the links of all its vectors, each other id once."""
    few = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0)]
    rng = np.random.default_rng(12)
    base = rng.standard_normal((8, 12))
    many = [(int(rng.integers(0, 25)), (base[rng.integers(0, 8)] + 1e-3 * rng.integers(0, 3)).tolist(), int(rng.integers(0, 2))) for _ in range(80)]
    for rows in (few, many, many + [(3, None, 1), (40, None, 0), (40, None, 0)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
        cosine = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
        linked = {i: {j for j, w, m in rows if j != i and w and any(k == i and v and m == n and cosine(v, w) >= 0.98 for k, v, n in rows)} for i, _, _ in rows}
        want = brute_components(linked, lambda a, b: b in linked[a])
        got = embed_dedup.near_vectors(df).collect()
        assert len(got) == len(rows)
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, len(linked[i]), want[i], want[i] == i) for i, _, _ in rows}


def test_roots_of_links():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, 25), rng.integers(0, n, 25)
        want = brute_components({i: None for i in range(n)}, lambda x, y: ((a == x) & (b == y) | (a == y) & (b == x)).any())
        assert embed_dedup._roots(a, b, n).tolist() == [want[i] for i in range(n)]


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("", "", "allow")][:5], "host string, path string, verdict string")
    urls = ["https://WWW.Example.org/es/x?q#f", "http://example.org/en/12", "http://notexample.org/es/", "http://a.com/fr", "http://a.com/de/?x", "x", None, "http://b.org", "http://b.org?a/", "ftp://h://y/z", "http://a.com/de/", "http://a.com/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {
        0: ("www.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("notexample.org", "/es/", "org/", "allow"), 3: ("a.com", "/fr", None, "allow"),
        4: ("a.com", "/de/", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b.org", "", None, "allow"), 8: ("b.org", "", None, "allow"), 9: ("h:", "//y/z", None, "allow"),
        10: ("a.com", "/de/", "com/de/", "block"), 11: ("a.com", "/de/", "com/de/", "block"),
    }
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def labelled(n=240, seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta"]) for _ in range(rng.randint(1, 3)))
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 90))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "zwog" + word()
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_toxicity_learns_and_handles_edges(spark):
    texts, toxic = labelled()
    net = toxicity.train(texts[:160], toxic[:160])
    score = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(docs(spark, texts[160:] + ["", None, "!!!"]), net).collect()}
    right = sum((score[i] >= toxicity.PREDICT_AT) == bool(y) for i, y in enumerate(toxic[160:]))
    assert right >= 0.95 * len(toxic[160:]) and score[80] == score[81] == score[82] == 0.0
    assert toxicity.with_toxicity(docs(spark, []), net).count() == 0
    assert toxicity.train([], []).scale == toxicity.train(["one"], [0]).scale == 0.0


def test_toxicity_gradients_match_differences():
    net = toxicity.Network(1)
    words = toxicity._slice_of(["a bad word here", "some other text"])
    at, text = words.windows()
    target = np.array([1.0, 0.0], np.float32)[text]
    g = net.gradients(words, at, target)

    def loss():
        q = toxicity.sigmoid(net.run(net.inputs(words), at).astype(np.float64))
        return -np.mean(target * np.log(q) + (1 - target) * np.log(1 - q))

    for name, place in (("wf", (0, 0)), ("ub", (2, 9)), ("att", (3, 1)), ("out", (5,)), ("word", (words.word[0], 2)), ("char", (words.tri[3], 1))):
        kept = net.p[name][place]
        net.p[name][place] = kept + 1e-2
        up = loss()
        net.p[name][place] = kept - 1e-2
        down = loss()
        net.p[name][place] = kept
        assert abs((up - down) / 2e-2 - g[name][place]) < 2e-3


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["%%%", "###a", "!!", "||"]) for _ in range(60))
    texts = [good() if i % 3 else bad() for i in range(120)] + ["", None]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = quality.drop_low_quality(df, labels, "source", "lang")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} - {120, 121} == {i for i in range(120) if i % 3}
    none = quality.drop_low_quality(df.limit(0), labels, "source", "lang")
    assert none.count() == 0


def test_quality_posterior_equals_brute_force(spark):
    rng = random.Random(19)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([-3.0, -0.5, 0.0, 2.0, 12.0])) for i in range(160)] + [(7, "a", "x", 2.0)] * 3
    rate = 0.7
    base = math.log(rate / (1 - rate))
    own = [1 / (1 + math.exp(-(r[3] + base))) for r in rows]
    sums = lambda key: {k: (sum(key(r) == k for r in rows), sum(o for r, o in zip(rows, own) if key(r) == k)) for k in map(key, rows)}
    sites, paths = sums(lambda r: r[1]), sums(lambda r: r[1:3])
    mean = (sum(own) + 1) / (len(rows) + 2)

    def strength(levels):
        total = sum(n for n, _, _ in levels)
        between, within = sum(n * (g / n - m) ** 2 for n, g, m in levels), sum(n * m * (1 - m) for n, _, m in levels)
        var = within / total
        spread = (between - len(levels) * var) / max(total - sum(n * n for n, _, _ in levels) / total, 1e-9)
        return 1e6 if spread <= var * 1e-6 else min(max(var / spread - 1, 1.0), 1e6)

    k_site = strength([(n, g, mean) for n, g in sites.values()])
    site = lambda n, g: (g + k_site * mean) / (n + k_site)
    k_path = strength([(n, g, site(*sites[k[0]])) for k, (n, g) in paths.items()])
    df = spark.createDataFrame(rows, "doc_id long, site string, path string, evidence double").withColumn("quality", F.lit("clash"))
    got = sorted((r.doc_id, r.site or "", r.path or "", r.evidence, r.quality) for r in quality.posterior(df, F.col("site"), F.col("path"), rate).collect())
    want = []
    for r, o in zip(rows, own):
        (n, g), (pn, pg) = sites[r[1]], paths[r[1:3]]
        prior = (pg - o + k_path * site(n - 1, g - o)) / (pn - 1 + k_path)
        want.append((r[0], r[1] or "", r[2] or "", r[3], 1 / (1 + math.exp(-(r[3] + math.log(prior / (1 - prior)))))))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-9


def test_quality_evidence_equals_brute_force():
    texts = ["one two two", "", "ab", "ONE!! TWO!!", "one two " * 9000]
    model = quality.Model(["good text here is fine", "more good text of ours", "BAD!! TEXT!!", "VERY!! BAD!!"], [1, 1, 0, 0])
    for text in texts:
        raw = text.encode()
        pairs = [model.w[raw[i] << 8 | raw[i + 1]] for i in range(len(raw) - 1)]
        buf = np.frombuffer(raw, np.uint8)
        t = quality.Tokens(buf, np.array([0, len(raw)]))
        words = [model.w[quality.PAIRS + w] for w in t.words]
        assert len(words) == len(text.split())
        want = sum(map(float, pairs)) / (len(pairs) + quality.MORE_PAIRS) + sum(map(float, words)) / (len(words) + quality.MORE_WORDS) + float(model._expand(t.shape)[0] @ model.dense) - model.base
        whole = b"xx yy" + raw + b"zz"
        got = model.evidence(np.frombuffer(whole, np.uint8), np.array([0, 5, 5 + len(raw), len(whole)]))
        assert abs(got[1] - max(-12, min(12, want))) < 1e-6


def test_network_equals_a_plain_loop():
    """The forward pass, word by word in Python floats, and all windows of a text."""
    net = toxicity.Network(5)
    p = {k: v.astype(float) for k, v in net.p.items()}
    text = " ".join(f"word{k} and" for k in range(21))
    words = toxicity._slice_of([text])
    at, _ = words.windows()
    assert at.tolist() == [[words.at[k + j] if k + j < 42 else -1 for j in range(toxicity.WINDOW)] for k in range(0, 19 if len(at) == 2 else 31, toxicity.STEP)][: len(at)] and max(map(max, at.tolist())) >= 0
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN
    for row, got in zip(at, net.run(net.inputs(words), at), strict=True):
        seen = [w for w in row if w >= 0]
        x = [np.concatenate([p["word"][words.word[w]], 0.5 * sum(p["char"][k] for k in words.tri[words.tri_from[w] : words.tri_from[w + 1]])]) for w in seen]
        states = np.zeros((len(seen), 2 * h))
        for side, way in enumerate("fb"):
            now = np.zeros(h)
            for k in range(len(seen)) if way == "f" else range(len(seen) - 1, -1, -1):
                a, r = x[k] @ p[f"w{way}"] + p[f"b{way}"], now @ p[f"u{way}"]
                z, reset = sig(a[:h] + r[:h]), sig(a[h : 2 * h] + r[h : 2 * h])
                now = (1 - z) * np.tanh(a[2 * h :] + reset * r[2 * h :]) + z * now
                states[k, side * h : side * h + h] = now
        e = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
        assert abs(float((e / e.sum()) @ states @ p["out"] + p["out_b"][0]) - float(got)) < 1e-4


CLASHING = ["toxicity", "evidence", "quality", "site_prior", "path_prior", "benchmark_hits", "component_id", "n_shingles", "_c0", "_c3", "_site", "_row", "token_ids_", "rep"]


def test_dropping_stages_keep_columns_of_any_name(spark):
    texts, toxic = labelled(60)
    df = docs(spark, [*texts, None, ""])
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"kept {name}"))
    labels = spark.createDataFrame([(i, 1 - t, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, texts[1])], "item_id long, text string")
    for out in (toxicity.drop_toxic(df, labels), quality.drop_low_quality(df, labels, "source", "lang"), jaccard_join.drop_near_copies(df), decontaminate.drop_contaminated(df, bench)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[name] == f"kept {name}" for r in rows for name in CLASHING)
        assert {60, 61} <= {r.doc_id for r in rows} or out.count() < 62
        assert [r.text for r in rows] == [(texts + [None, ""])[r.doc_id] for r in rows]
    urls = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    for name in ("short", "_row", "_digest", "_best", "r_host", "_c0"):
        urls = urls.withColumn(name, F.lit("mine"))
    got = url_filter.judge_urls(urls, spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")).first()
    assert got.verdict == "block" and {got[c] for c in ("short", "_row", "_digest", "_best", "r_host", "_c0")} == {"mine"}


def test_very_long_inputs(spark):
    """Texts of megabytes, whole: what counts stands at their end."""
    texts, toxic = labelled(160)
    net = toxicity.train(texts, toxic)
    filler = "kalo mine " * 60_000
    score = [r.toxicity for r in toxicity.with_toxicity(docs(spark, [filler, filler + "zwogkalo"]), net).orderBy("doc_id").collect()]
    assert score[0] < toxicity.PREDICT_AT <= score[1]
    rules = spark.createDataFrame([("example.org", "/" + "a" * 50_000, "block")], "host string, path string, verdict string")
    url = "http://" + "b." * 20_000 + "example.org/" + "a" * 50_000
    got = url_filter.judge_urls(spark.createDataFrame([(1, url), (2, url[:-1])], "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow"]
    one = piece_codec.encode_pieces(docs(spark, ["x" * 30_000, "word " * 200_000])).collect()
    assert all(r.roundtrip for r in one)


def test_shingles_of_long_and_odd_texts():
    texts = ["w " * 300_000, "\u00a0nbsp\u2003em", "A" * 2_000_000 + " b c d e f"]
    sizes = [len(s) for s in jaccard_join.shingle_sets(pa.array(texts))]
    assert sizes == [1, 1, 2]


def test_html_keeps_all_but_the_listed_parts():
    text = html_template.extract_text
    assert text('<article><p>one <svg class="i"/> two</p><p>three</p>') == "one two\n\nthree"
    assert text("<article><p>one <svg><path d='M0'/><text>no</text></svg> two</p></article>") == "one two"
    assert text("<article><p>a <math/> b</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "a b\n\nso x=2 holds"
    assert text("<article><object data='x'><p>instead of it</p></object><canvas>drawn: 3</canvas></article>") == "instead of it\n\ndrawn: 3"


def html_texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_keeps_what_near_copies_and_articles_share(spark):
    shared = [f"paragraph {k} {'says as much ' * (k + 3)}".strip() for k in range(6)]
    body = "".join(f"<p>{p}</p>" for p in shared)
    for frame in ("<body><article>{}</article></body>", "<body><div>{}</div></body>"):
        assert html_texts(spark, [frame.format(f"<h1>no {i}</h1>{body}") for i in range(60)]) == ["\n\n".join([f"no {i}", *shared]) for i in range(60)]
    for parts in (6, 20):
        altered = [[f"part {k} {'says as much ' * 9}{f'once {i}' if k == i % parts else 'always'}" for k in range(parts)] for i in range(60)]
        assert html_texts(spark, ["<body><div>{}</div></body>".format("".join(f"<p>{p}</p>" for p in page)) for page in altered]) == ["\n\n".join(page) for page in altered]
    for n in (9, 10):
        pages = [f"<body><article><p>About this site</p><p>story {i} {'w' * (40 + i)}</p></article></body>" for i in range(n)]
        assert html_texts(spark, pages) == [f"About this site\n\nstory {i} {'w' * (40 + i)}" for i in range(n)]
        pages = [f"<body><div><p>About this site</p><p>story {i} {'w' * (40 + i)}</p></div></body>" for i in range(n)]
        assert html_texts(spark, pages) == [f"story {i} {'w' * (40 + i)}" for i in range(n)]


@pytest.mark.parametrize("most", [html_template.BROADCAST_TOKENS, 0])
def test_html_drops_every_constant_text(spark, monkeypatch, most):
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", most)
    menu = "".join(f"<li>country {k}</li>" for k in range(700))
    stories = [" ".join(f"word{i}x{k}" for k in range(900)) for i in range(30)]
    assert html_texts(spark, [f"<body><div><ul>{menu}</ul><p>{s}</p></div></body>" for s in stories]) == stories


@pytest.mark.parametrize("most", [html_template.BROADCAST_TOKENS, 0])
def test_html_slots_without_telling_names(spark, monkeypatch, most):
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", most)
    stories = [" ".join(f"word{i}x{k}" for k in range(60)) for i in range(40)]
    menus = ["".join(f'<a href="/{k}">entry {(i * 7 + k) % 90}</a> ' for k in range(5)) for i in range(40)]
    frame = '<body><div class="c1">{}</div><div class="c2"><p>{}</p><div class="c3">Buy offer {} today</div><p>end {}</p></div><div class="c4">seen {} times</div></body>'
    assert html_texts(spark, [frame.format(menus[i], stories[i], i % 8, i, i * 31) for i in range(40)]) == [f"{stories[i]}\n\nend {i}" for i in range(40)]


def test_html_is_read_in_linear_time():
    for page in ('<a "' * 60_000, "</a" * 60_000, "<a '" * 60_000 + "x>", "<script>" * 30_000, "<div>" * 20_000 + "x", "<div>x</span>" * 30_000, "<p " + 'a="' * 60_000):
        began = time.time()
        html_template.extract_text(page)
        assert time.time() - began < 5
    assert html_template.extract_text("<div>" * 20_000 + "x" * 100_000) == "x" * 100_000


def test_html_names_decide_nothing_within_articles():
    text = html_template.extract_text
    for inner in ('<div class="related-work">kept</div>', '<p class="alert">kept</p>', '<section class="signup">kept</section>', '<div id="banner-year-1848">kept</div>', '<p hidden>kept</p>', '<div aria-hidden="true" style="display:none">kept</div>'):
        assert text(f"<article><p>one</p>{inner}<p>two</p></article>") == "one\n\nkept\n\ntwo"
    assert text('<article>a <span class="share">share price</span> rose</article>') == "a share price rose"
    assert text('<article class="comment">Reader says hi</article><article>Main</article>') == "Main"
    assert text('<article>Main<article class="comment-12 odd">Reader</article></article><article class="teaser">Next</article>') == "Main"
    assert text('<article>Main<section id="comments"><p>Reader</p></section><nav>no</nav><aside>no</aside></article>') == "Main"
    assert text('<main><div class="c1">Menu</div><article>Main</article><div class="c2">Reader comments</div></main>') == "Main"
    assert text('<main><div class="sidebar">no</div><p>Main</p></main><p>out</p>') == "Main"


@pytest.mark.parametrize("n", [1, 2, 3, 50])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_html_known_main_texts(spark, n, frame):
    """Pages made from known blocks: what several pages of a small host share is text, and comes out whole."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(2)] if n < 4 else []
    texts = [[" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(2, 5))] + shared for _ in range(n)]
    around = '<body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>{}<footer>end</footer></body>'
    assert html_texts(spark, [around.format(frame.format("".join(f"<p>{t}</p>" for t in page))) for page in texts]) == ["\n\n".join(page) for page in texts]


def test_html_slots_decide_inside_main(spark):
    stories = [" ".join(f"word{i}x{k}" for k in range(60)) for i in range(30)]
    menu = "".join(f'<a href="/{k}">entry {k}</a> ' for k in range(8))
    pages = [f'<body><main><div class="c1">{menu}</div><div class="c2"><p>{s}</p></div></main></body>' for s in stories]
    assert html_texts(spark, pages) == stories


def test_html_deep_pages_with_a_template(spark):
    began = time.time()
    deep = ["<div>" * 8_000 + f"<p>text {i} {'w' * 50}</p>" for i in range(2)]
    assert html_texts(spark, deep) == [f"text {i} {'w' * 50}" for i in range(2)]
    assert time.time() - began < 60
    weight = {k: 1 for k in range(1, 8_001)}
    began = time.time()
    assert html_template.heaviest(Counter(weight), {k: k - 1 for k in weight}) == 7_999 and time.time() - began < 5
    assert html_template.heaviest(Counter({1: 5, 2: 5}), {1: 2, 2: 1}) in (0, 1, 2)


def test_html_classes_are_the_occurrence_vectors(spark):
    rng = random.Random(21)
    pages = []
    for i in range(14):
        items = "".join(f"<li><b>item {rng.random()}</b></li>" for _ in range(rng.randint(1, 4)))
        extra = '<section class="x"><p>more</p></section>' if i % 3 else ""
        pages.append(f'<body><div class="c1"><ul>{items}</ul></div>{extra}<div class="c2"><p>text {rng.random()} {"w" * i * 9}</p></div></body>')
    read = [html_template.read(p) for p in pages]
    assert len({html_template.near_key(b) for b, _ in read}) == len(pages)
    counts = [dict(zip(*np.unique([html_template.ROOT.token, *t], return_counts=True), strict=True)) for _, t in read]
    vectors = {}
    for token in set().union(*counts):
        vector = tuple(int(c.get(token, 0)) for c in counts)
        if sum(v > 0 for v in vector) >= len(pages) / 2:
            vectors.setdefault(vector, set()).add(int(token))
    df = html_template.read_pages(spark.createDataFrame([("h", p) for p in pages], "host string, html string"))
    got = {}
    for r in html_template.classes(df).collect():
        got.setdefault(r["class"], set()).add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, vectors.values()))


def test_html_classes_out_of_order_are_no_template():
    """Tokens whose order differs from page to page, and classes that cross, give no slots."""
    a, b, c = (html_template._token(html_template._hash(k), html_template.OPEN) for k in "abc")
    walk = html_template.Walk([a, b, a, b, c], html_template.Template({a: 1, b: 2, c: 1}, frozenset()))
    assert walk.crossed == {2} and walk.before == {a: {a}, b: {b}, c: {a}} and walk.slots.tolist() == [0, a, b, a, a, 0]


def test_html_template_changes_the_result(spark):
    """Without article, telling names or roles, what stays follows from the pages of the host."""
    stories = [" ".join(f"word{i}x{k}" for k in range(60)) for i in range(30)]
    pages = [f'<body><div class="q1"><a href="/a">one</a> <a href="/b">two {i % 4}</a></div><div class="q2"><h1>title {i}</h1><p>{s}</p></div><div class="q3"><p>All rights kept</p></div></body>' for i, s in enumerate(stories)]
    assert html_texts(spark, pages) == [f"title {i}\n\n{s}" for i, s in enumerate(stories)]
    assert all(html_template.extract_text(p) != t for p, t in zip(pages, html_texts(spark, pages), strict=True))


def test_html_keeps_columns_of_any_name(spark):
    rows = [(i, f"http://h.example/{i}", "<article>x</article>" if i else None) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("main", "_host", "host", "t", "t_main", "out", "constant", "_c0", "_salt", "near"):
        df = df.withColumn(name, F.lit(f"kept {name}"))
    got = html_template.extract_main_text(df)
    assert got.columns == [*df.columns, "text", "n_chars"]
    assert {(r.main, r._host, r._c0, r.t) for r in got.collect()} == {("kept main", "kept _host", "kept _c0", "kept t")}
