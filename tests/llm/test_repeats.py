"""Repeated-substring removal against brute force: every byte string, small alphabets, edits, self-repeats."""

import hashlib
import random

import pytest
from tilewright.llm import suffixes


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab" if rng.random() < 0.3 else "abcdefgh ij") for _ in range(rng.randint(60, 500))) for _ in range(40)]
    docs = []
    for i in range(300):
        kind, x = rng.random(), rng.choice(pool)
        if kind < 0.3:  # one byte edited
            x += rng.choice(pool)
            q = rng.randrange(len(x))
            x = x[:q] + "Z" + x[q + 1 :]
        elif kind < 0.4:  # one letter over and over
            x = "a" * rng.randint(0, 400)
        elif kind < 0.5:
            x = "ab" * rng.randint(0, 300) + rng.choice(pool)
        elif kind < 0.6:  # repeats itself
            x = x[rng.randrange(len(x)) :] + x * rng.randint(1, 4)
        elif kind < 0.8:
            x = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 300))) + x[rng.randrange(len(x)) :] + rng.choice(pool)
        docs.append((i * 3, x))
    return docs


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "_STRETCH", [1 << 16, 300][seed])
    docs = corpus(seed)
    if seed:  # a long text, and a passage that most documents hold
        docs = [(i, x + (" the common passage" * 9 if i % 3 == 0 and i % 7 else "") + (x * 400 if i == 30 else "")) for i, x in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()}
    assert got == brute(docs)
