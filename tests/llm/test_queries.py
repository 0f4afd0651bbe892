"""Registered queries against brute force, and operators on odd tables, small nodes and pieces."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tilewright.llm import decontaminate, langid, minhash, neighbours, packing, registry, tokens, toxicity, wordpiece
from tilewright.llm.common import word_hashes

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("queries"))
    rng = np.random.default_rng(7)
    make = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(int(rng.integers(1, 40))))
    rows = [(i, make("abcdefgh" if i % 2 else "stuvwxyz") + " rude vile" * (i % 5 == 0), "ab" if i % 2 else "uv") for i in range(160)]
    rows += [(160, None, "ab"), (161, "", "uv"), (162, "12 ?!", None), (None, "abc fed", "ab"), (7, "same id", None), (163, "gab " * 9000, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_language_query(spark, sf_dir):
    d, rows = sf_dir
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learn = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    names, p = langid.train(learn)
    got = sorted(((r.doc_id is None, r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in registry.op7_language_id(spark, d).collect()), key=str)
    want = []
    for i, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            want.append((i is None, i, held(i), "und", 0.0))
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        total, n = np.zeros(len(names)), len(data)
        for a in range(0, n, langid.SEGMENT):  # one segment at a time; the last one reaches back
            start = max(0, min(a, n - langid.SEGMENT))
            x = np.full((langid.SEGMENT, 1), 32, np.uint8)
            x[: min(langid.SEGMENT, n - start), 0] = data[start : start + langid.SEGMENT]
            forth = list(langid._run(p, "f", x))
            back = list(langid._run(p, "b", x[::-1]))[::-1]
            for t in range(a - start, min(langid.SEGMENT, n - start)):
                z = (p["of"] @ forth[t] + p["ob"] @ back[t] + p["b"])[:, 0].astype(float)
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want.append((i is None, i, held(i), names[int(total.argmax())], round(float(total.max() / n), 4)))
    want = sorted(want, key=str)
    assert [w[:4] for w in got] == [w[:4] for w in want]
    assert np.allclose([w[4] for w in got], [w[4] for w in want], atol=2e-3)


def test_toxicity_query(spark, sf_dir):
    d, rows = sf_dir
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    got = sorted(((str(r.doc_id), round(r.severity, 6), r.grade, r.toxic) for r in registry.op8_toxicity(spark, d).collect()))
    want = []
    for i, text, _ in rows:
        found = {w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower().encode()) if w}
        at = {int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] >> np.uint64(64 - toxicity.BITS)) for w in found}
        s = sum(float(model.weights[x]) for x in at)
        e = float((1 / (1 + np.exp(-(s - model.thresholds)))).sum()) if at else 0.0
        want.append((str(i), round(e, 6), model.values[int(np.rint(e))], e > 0.5))
    assert [(a, c, t) for a, _, c, t in got] == [(a, c, t) for a, _, c, t in sorted(want)]
    assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], atol=1e-5)
    assert {g[0] for g in got if g[3]} == {str(i) for i, t, _ in rows if "rude" in (t or "")}


def test_token_count_query(spark, sf_dir):
    """Greedy pieces, one word at a time, over the vocabulary as strings."""
    import json

    d, rows = sf_dir
    vocab = json.load(open(tokens.vocabulary("word_bpe_49k.json")))["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    letters = [chr(b) if b in shown else chr(next(spare)) for b in range(256)]
    seen: dict[bytes, int] = {}

    def pieces(word: bytes) -> int:
        """A last piece that does not close the word makes it one unknown token."""
        if word not in seen:
            symbols, n = "".join(letters[b] for b in word), 0
            while symbols and n >= 0:
                j = len(symbols) if symbols + "</w>" in vocab else next((j for j in range(len(symbols), 0, -1) if symbols[:j] in vocab), 0)
                closed = symbols + "</w>" in vocab
                n, symbols = (n + 1, symbols[j:]) if closed or 0 < j < len(symbols) else (-1, "")
            seen[word] = max(n, 1)
        return seen[word]

    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in registry.op3_token_counts(spark, d).collect())
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").lower().encode()) if w]
    words_of = [(str(i), split(t)) for i, t, _ in rows]
    assert [(a, n) for a, n, _ in got] == sorted((a, len(w)) for a, w in words_of)
    assert got == sorted((a, len(w), sum(map(pieces, w))) for a, w in words_of)


def test_small_nodes(spark, monkeypatch):
    """Nodes of over six documents branch again."""
    monkeypatch.setattr(minhash, "SMALL", 6)
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(WORDS, 80)) for _ in range(3)]
    texts = []
    for i in range(40):
        w = base[i % 3].split()
        for _ in range(int(rng.integers(0, 5))):
            w[rng.integers(0, len(w))] = "edit"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert [got[i] for i in range(len(texts))] == root


def test_decontamination_in_pieces(spark, monkeypatch):
    """Windows over the edges of pieces, and several blocks of benchmark windows."""
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    rng = np.random.default_rng(9)
    text = [" ".join(rng.choice(WORDS, n)) for n in (120, 37, 16, 17, 25, 3, 10)] + ["", None]
    bench = [(1, " ".join(text[0].split()[10:30])), (2, " ".join(text[1].split()[8:20])), (3, " ".join(text[0].split()[14:19])), (4, text[5]), (5, " ".join(text[3].split()[6:16])), (None, text[6]), (1, "nothing like it")]
    docs = spark.createDataFrame([*enumerate(text), (None, text[3]), (0, text[4])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.hits(docs, spark.createDataFrame(bench, "item_id long, text string")).collect())
    want = []
    for i, t in [*enumerate(text), (None, text[3]), (0, text[4])]:
        w, hit, found = (t or "").split(), set(), set()
        for item, b in bench:
            x = b.split()
            m = min(10, len(x))
            for j in range(len(x) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[j : j + m]:
                        hit |= set(range(p, p + m))
                        found.add("null" if item is None else str(item))
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    assert got == sorted(want)


def test_padding(spark):
    """One partition's sequences are full, but for one a group."""
    docs = spark.createDataFrame([(i, " ".join(WORDS[: 1 + i % 50])) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), capacity=256).collect()
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sum(256 - n for n in filled.values()) < 256


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert wordpiece.token_counts(none, tokens.vocabulary("word_bpe_49k.json")).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert decontaminate.hits(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    pieces = packing.pack(odd, tokens.vocabulary("byte_bpe_50k.json")).filter("start = 0").collect()
    assert sorted(str(r.doc_id) for r in pieces) == ["1", "1", "None", "None"]
