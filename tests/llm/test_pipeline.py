"""The corpus pipeline over planted documents, stage by stage, against brute force."""

import random
import re

import pytest

import corpus_pipeline
from roundlens.llm import piece_codec, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, bad, copied and contaminated documents, nulls, empties, repeated rows and a clashing column."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    kinds, texts = [], []

    def add(kind, text):
        kinds.append(kind)
        texts.append(text)

    for _ in range(160):
        add("clean", prose(rng.randint(30, 90)))
    for _ in range(60):
        add("toxic", " ".join([prose(30), "zwog" + word(), prose(20)]))
    for _ in range(60):
        add("bad", " ".join(rng.choice(["%%%", "###", "!!", "||"]) + word() for _ in range(60)))
    items = [prose(30) for _ in range(5)]
    for item in items:
        add("leak", f"{prose(80)} {item} {prose(70)}")
    for k in range(6):
        first = texts[k].split()
        add("copy", " ".join(first))
        first[len(first) // 2] = "other"
        add("near", " ".join([*first[:1], *first[1:]]))
    add("null", None)
    add("empty", "")
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b"][i % 2], len(t or ""), f"mine {i}") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "a", 5, "no id"), (rows[20][0], *rows[20][1:])]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, evidence string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(k not in ("bad",)), int(k == "toxic")) for i, k in enumerate(kinds) if k in ("clean", "toxic", "bad")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), kinds, texts, items


def test_stages_and_run(spark, folder):
    path, kinds, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    of = lambda *names: {i for i, k in enumerate(kinds) if k in names}
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, docs, path), f"test-{name}")
        assert out.columns == columns
        kept[name] = ids(out)
        before = {(r.doc_id, r.text, r.evidence) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.evidence) for r in out.collect()} <= before
        if name == "near_copies":  # against all pairs
            rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None})
            sets = {i: shingles(t) for i, t in rows}
            root = {i: i for i in sets}
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = root[a], root[b]
                        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
            assert {i for i in kept[name] if i is not None} == {i for i in sets if root[i] == i}
        if name == "decontamination":  # against a search for the items themselves
            assert {i for i in kept[name] if i is not None} == {r.doc_id for r in docs.collect() if r.doc_id is not None and not any(item in (r.text or "") for item in items)}
        docs = out
    held_out = lambda i: spark.range(1).selectExpr(f"crc32('{i}') % 4 = 2").first()[0]
    assert held_out(5) in (True, False)
    assert not of("toxic") & set(kept["toxicity"]) and of("clean", "leak", "copy", "near", "null", "empty") <= set(kept["toxicity"]) and None in kept["toxicity"]
    assert not of("bad") & set(kept["quality"]) and of("clean", "leak") <= set(kept["quality"])
    assert not of("copy") & set(kept["near_copies"]) and not of("leak") & set(kept["decontamination"])
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id for r in got), key=str) == kept["decontamination"]
    model = piece_codec.load(piece_codec.MODEL)
    for r in got:
        if r.doc_id is not None:
            assert r.token_ids == model.encode([texts[r.doc_id] or ""])[0] and r.n_tokens == len(r.token_ids) and r.roundtrip


def test_stages_of_nothing(spark, folder):
    path = folder[0]
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, path).count() == 0


def test_thresholds_are_those_of_the_contract():
    assert toxicity.PREDICT_AT == 0.3 and 0 < quality.KEEP_AT < 1
