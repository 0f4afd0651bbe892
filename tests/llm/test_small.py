"""Each operator against brute force on small fixtures with nulls, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import dac, decontaminate, langid, lm, minhash, neighbours, packing, suffixes, tokens, toxicity, wordpiece
from tilewright.llm.common import utf8

WORDS = [f"w{i}" for i in range(60)]


def texts(seed=4):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(WORDS, 80)) for _ in range(6)]
    out = [None, "", "   ", "one", "a b c", "A B C", base[0], base[0], base[1].upper(), "é" * 150, "x" * 260]
    for i in range(30):
        w = base[i % 6].split()
        for _ in range(int(rng.integers(0, 6))):
            w[rng.integers(0, len(w))] = "edit"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, root string, n long, node long")


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (None, "a b c d e f"), (None, None), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(t):
    return (t or "").encode().lower().split()


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 4).collect()}
    sets = {}
    for i, t in enumerate(texts()):
        w = words(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


def test_suffixes(docs):
    seen = set()
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=True).collect()}
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256, got[i].kept_text) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))


def test_automaton():
    rng = np.random.default_rng(0)
    for _ in range(40):
        pieces = {tuple(rng.integers(97, 100, rng.integers(1, 5)).tolist()) + ((wordpiece.END,) if rng.random() < 0.5 else ()) for _ in range(8)}
        auto = wordpiece.Automaton(list(pieces))
        some = [bytes(rng.integers(97, 100, rng.integers(1, 10)).tolist()) for _ in range(20)]
        data = np.frombuffer(b" ".join(some), np.uint8)
        got = auto.counts(*wordpiece.word_bounds(data, np.array([0, len(data)])))
        for word, n in zip(some, got, strict=True):
            w, i, want = (*word, wordpiece.END), 0, 0
            while i < len(w) and want >= 0:
                j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), 0)
                i, want = (j, want + 1) if j else (i, -1)
            assert n == want


def test_token_counts(docs, odd):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = {r.doc_id: r for r in wordpiece.token_counts(docs, path).collect()}
    assert all(got[i].n_words == len(words(t)) and got[i].n_unknown == 0 and got[i].n_tokens >= got[i].n_words for i, t in enumerate(texts()))
    assert wordpiece.token_counts(odd, path).count() == 6


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=64).collect()
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts())}
    for i, ids in want.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [s for s, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]] and sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n]) == c for s, n, c in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 64


def test_packing_cost():
    pieces = packing.assign([9, 8, 7, 3, 3, 2], 16)
    assert sum(p[2] for p in pieces) == 32 and len({p[3] for p in pieces}) == 2


def test_codes():
    ids = np.random.default_rng(1).integers(0, 1 << 18, 3000).astype("<u4")
    ids[::2] %= 200
    s = dac.Segment(dac.encode(ids, np.array([5]), np.array([0])))
    assert (s.all() == ids).all() and [s.id(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    empty = dac.Segment(dac.encode(ids[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert empty.n == 0 and len(empty.all()) == 0


def test_stretches():
    ids = np.random.default_rng(1).integers(0, 1 << 18, 5000).astype("<u4")
    ids[::2] %= 200
    s = dac.Segment(dac.encode(ids, np.array([5]), np.array([0])))
    for a, b in ((0, 5000), (0, 0), (5000, 5000), (4999, 5000), (511, 1025), (512, 512), (7, 9)):
        assert (s.stretch(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    """Every character of the fast path between letters, spaces, digits and endings, and the strings of added tokens."""
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(tokens.vocabulary(name)), np.random.default_rng(2)
    some = [a + c + b for c in tokens._SAFE for a, b in (("x", "y"), (" ", " "), ("1", "'s"))]
    some += ["".join(rng.choice(tokens._SAFE, 12)) for _ in range(2000)]
    some += ["a <|endoftext|> b", "<|ENDOFTEXT|>x", "<|startoftext|>", "<|", "a<|endoftext|"]
    for special in (False, True):
        lib.encode_special_tokens = special
        for t, got in zip(some, tokens.Encoder(tokens.vocabulary(name), special).packed(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_files(docs, odd):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    lib, at = Tokenizer.from_file(path), 0
    for r, t in zip(sorted(dac.token_files(docs, path).collect()), texts(), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert dac.token_files(odd, path).count() == 6


def test_decontamination(spark, docs):
    bench = [(1, " ".join(texts()[6].split()[3:20])), (2, "A b, C"), (3, None), (4, "..."), (4, "nothing of the kind is anywhere in these texts at all")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    got = {r.doc_id: r for r in decontaminate.hits(docs, items).collect()}
    for i, t in enumerate(texts()):
        w, hit, found = split(t), set(), set()
        for item, b in bench:
            x = split(b)
            m = min(10, len(x))
            for j in range(len(x) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[j : j + m]:
                        hit |= set(range(p, p + m))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    none = decontaminate.hits(docs, items.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0]), (None, [1.0] * 8), (304, [None] * 8)]
    rows[250] = (250, rows[3][1])
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50, k=5).collect()
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    for q in range(0, 300, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 9), (1, 9), (40, 64), (3000, 1 << 45)):
        x = np.unique(rng.integers(0, u, n).astype(np.uint64))
        q = np.concatenate([x, rng.integers(0, u, 50).astype(np.uint64)])
        f = lm.EliasFano.of(x, u)
        assert (f.find(q) == np.where(np.isin(q, x), np.searchsorted(x, q), -1)).all()
        assert (f.get(np.arange(len(x))) == x).all()
    repeated = np.sort(rng.integers(0, 50, 400)).astype(np.uint64)
    assert (lm.EliasFano.of(repeated, 51).get(np.arange(400)) == repeated).all()


def test_trie():
    rng = np.random.default_rng(6)
    contexts = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    keys = np.unique(rng.integers(0, len(contexts), 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 500, 3000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    totals = np.bincount((keys >> np.uint64(32)).astype(int), counts, len(contexts)).astype(np.int64)
    trie = lm.Trie(bytes(lm.Trie.build(contexts, totals, keys, counts, 4.0).buffer))
    asked = np.concatenate([contexts, [np.uint64(3)]])
    of, successor = np.repeat(np.arange(len(asked)), 520), np.tile(np.arange(520), len(asked)).astype(np.uint64)
    back, share = trie.look(asked, of, successor)
    known = {int(k): c for k, c in zip(keys, counts, strict=True)}
    want = [known.get((int(o) << 32) + int(x), 0) / (totals[o] + 4) if o < len(contexts) else 0 for o, x in zip(of, successor, strict=True)]
    assert np.allclose(lm._VALUES[share], want, rtol=0.05) and ((share > 0) == (np.array(want) > 0)).all()
    assert np.allclose(lm._VALUES[back[:-1]], 4 / (totals + 4), rtol=0.05) and back[-1] == 255


def brute_scores(every, got, held):
    learn = [w for i, w in every.items() if not held(i)]
    pad = lambda w: [0, *w[:-1]]
    c, two = Counter(x for w in learn for x in w), Counter(p for w in learn for p in zip(pad(w), w, strict=True))
    c[0] = len(learn)
    three = Counter(p for w in learn for p in zip(pad(w)[:-1], w, w[1:], strict=False))
    n, v = sum(c.values()) - len(learn), len(c) - 1
    for i, w in every.items():
        low, p = np.array([(c[x] + 1) / (n + v + 1) for x in w]), []
        for j, x in enumerate(w):
            u = w[j - 1] if j else 0
            q = (two[u, x] + 4 * low[j]) / (c[u] + 4)
            if j:
                t = w[j - 2] if j > 1 else 0
                if two[t, u] >= 2:
                    q = (three[t, u, x] + 4 * q) / (two[t, u] + 4)
            p.append(q)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(i))
        assert abs(r.base_score - np.log10(low).sum()) < 1e-6 and abs(r.score - np.log10(p).sum()) < 0.04 * len(w)


def test_scores(docs, odd, tmp_path):
    every = {i: [*words(t), None] for i, t in enumerate(texts())}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute_scores(every, {r.doc_id: r for r in lm.scores(docs, model_path=str(tmp_path / "model")).collect()}, held)
    assert docs.sparkSession.read.parquet(str(tmp_path / "model")).count() == 2
    assert lm.scores(odd).count() == 6


def test_scores_in_pieces(docs, spark, monkeypatch):
    """Texts over several blocks, contexts in several pieces, many shards."""
    for name, value in (("BLOCK", 600), ("BLOCK_TOKENS", 50), ("TEXT", 90), ("PIECE", 8), ("SHARD", 100)):
        monkeypatch.setattr(lm, name, value)
    names = ("BLOCK", "BLOCK_TOKENS", "TEXT", "PIECE")
    values = [getattr(lm, x) for x in names]
    inner = lm._blocks

    def blocks(batches):
        from tilewright.llm import lm as here

        for x, y in zip(names, values, strict=True):
            setattr(here, x, y)
        yield from inner(batches)

    monkeypatch.setattr(lm, "_blocks", blocks)
    grams = lm._gram_messages

    def messages(order, shards, some):
        run = grams(order, shards, some)

        def go(a, b):
            from tilewright.llm import lm as here

            here.PIECE = values[3]
            return run(a, b)

        return go

    monkeypatch.setattr(lm, "_gram_messages", messages)
    scored = lm._scores

    def last(n, v):
        run, schema = scored(n, v)

        def go(a, b):
            from tilewright.llm import lm as here

            here.PIECE = values[3]
            return run(a, b)

        return go, schema

    monkeypatch.setattr(lm, "_scores", last)
    every = {i: [*words(t), None] for i, t in enumerate(texts())}
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    brute_scores(every, got, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._start(3, rng).items()}
    x, y = rng.integers(97, 100, (7, 4)), np.array([0, 1, 2, 1])

    def loss():
        states = list(langid._run(p, "f", x)), list(langid._run(p, "b", x[::-1]))
        return -np.mean([np.log(langid._softmax(p["of"] @ states[0][t] + p["ob"] @ states[1][6 - t] + p["b"])[y, range(4)]) for t in range(7)])

    g = langid._gradients(p, x, y)
    for k, at in (("ef", (2, 98)), ("eb", (9, 97)), ("uf", (1, 2)), ("ub", (14, 3)), ("of", (1, 1)), ("b", (0, 0))):
        p[k][at] += 1e-5
        up = loss()
        p[k][at] -= 2e-5
        down = loss()
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4


def test_language(spark):
    rng = np.random.default_rng(3)
    make = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(30))
    rows = [(i, make("abcdef" if i % 2 else "uvwxyz"), "ab" if i % 2 else "uv") for i in range(200)]
    frame = spark.createDataFrame([*rows, (900, None, "ab"), (901, "12 ?!", "uv"), (902, "", None), (903, "fabed", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, langid.train(frame.filter("doc_id < 100"))).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[100:]]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "ab"


def test_ordinal(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        y = i % 3
        rows.append((i, " ".join([*rng.choice(WORDS, 30), *["rude"] * (y > 0), *["vile"] * (y > 1)])))
        labels.append((i, y))
    rows += [(900, None), (901, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (902, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].grade == y for i, y in labels]) > 0.95
    assert got[900].severity == got[901].severity == 0
    assert toxicity.train(docs, marks.limit(0)).expected(*utf8(__import__("pyarrow").array(["vile"])))[0] < 1e-9


@pytest.mark.parametrize("f", [lambda d: minhash.near_duplicates(d), lambda d: suffixes.remove_repeats(d), lambda d: lm.scores(d), lambda d: dac.token_files(d, tokens.vocabulary("word_bpe_49k.json")), lambda d: packing.pack(d, tokens.vocabulary("byte_bpe_50k.json"))])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids(odd):
    assert sorted((r.doc_id is None, r.n_shingles) for r in minhash.near_duplicates(odd).collect()) == [(False, 0), (False, 1), (False, 2), (False, 2), (True, 0), (True, 2)]
    assert minhash.near_duplicates(odd).filter("kept").count() == 2 + 2
    assert suffixes.remove_repeats(odd).count() == 6
