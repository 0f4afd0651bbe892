"""Every stage of the corpus pipeline, and run(), against brute force on one small corpus."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tilewright.llm import tokens

WORDS = [f"w{i}" for i in range(400)]
ITEM = " ".join(f"exam{i}" for i in range(12))


def corpus():
    """Distinct (doc_id, text) rows: half hold rude words; near copies, shared passages, an item, null and repeated ids."""
    rng = np.random.default_rng(21)
    make = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(1000 + i, make(30) + " vile rude awful" * (i % 2)) for i in range(200)]
    base, passage = make(60), make(40)
    rows += [(1, base), (1, base + " end"), (2, base + " other"), (None, base + " null"), (3, passage + " " + make(60)), (3, make(50) + " " + passage), (4, make(20) + " " + ITEM), (4, make(20)), (None, make(9)), (None, None), (5, "")]
    return rows


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, (row[1] or "").encode())


def not_toxic(rows):
    return [r for r in rows if "vile" not in (r[1] or "")]


def unlike(rows):
    rows = sorted(rows, key=order)
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in range(len(rows))):
            break
    return [r for a, r in enumerate(rows) if root[a] == a]


def uncopied(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=order):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            gone[p : p + 100] |= b[p : p + 100] in seen
            seen.add(b[p : p + 100])
        out.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode()))
    return out


def clean(rows):
    return [r for r in rows if not any(" ".join(ITEM.split()[j : j + 10]) in (r[1] or "") for j in range(3))]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("chain"))
    rows = [(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_run(spark, sf_dir):
    docs, want = spark.read.parquet(f"{sf_dir}/documents.parquet"), corpus()
    for (name, stage), plain in zip(cp.STAGES[:-1], (not_toxic, unlike, uncopied, clean), strict=True):
        path = cp.shared_dir(spark)
        before = len(want)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs, want = spark.read.parquet(path), plain(want)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=order) == sorted(want, key=order), name
        assert len(want) < before or name == "suffix-dedup"

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    ids = [(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in want]
    pieces = cp.run(spark, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in ids)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0) == sorted((str(i), len(x)) for i, x in ids)
    for r in pieces:
        assert any(i == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for i, x in ids)
