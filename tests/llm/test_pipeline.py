"""The corpus pipeline's stages on rows with null and repeated ids."""

import numpy as np
import pytest

import corpus_pipeline as cp

RNG = np.random.default_rng(8)
TEXT = [" ".join(RNG.choice([f"w{i}" for i in range(400)], 40)) for _ in range(12)]
ITEM = " ".join(f"exam{i}" for i in range(12))
RUDE = " vile rude awful"


def make(spark, rows):
    """Rows (doc_id, text), each with its own source."""
    full = [(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def plain(frame):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Benchmark and labels; documents 1000 and up are labelled and hold the rude words where toxic."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def labelled():
    rng = np.random.default_rng(9)
    return [(1000 + i, " ".join(rng.choice([f"w{i}" for i in range(400)], 30)) + RUDE * (i % 2)) for i in range(200)]


def test_toxic_rows(spark, sf_dir):
    odd = [(1, TEXT[0]), (1, TEXT[1] + RUDE), (1, TEXT[0]), (None, TEXT[2]), (None, TEXT[3] + RUDE), (None, None), (2, "")]
    docs = make(spark, odd + labelled())
    want = [r for r in plain(docs) if "vile" not in (r[1] or "")]
    assert plain(cp.drop_toxic(spark, docs, sf_dir)) == want


def test_near_duplicate_rows(spark, sf_dir):
    odd = [(1, TEXT[0]), (1, TEXT[0]), (1, TEXT[1]), (None, TEXT[2]), (None, TEXT[2] + " more"), (None, None), (None, None), (3, TEXT[2]), (4, TEXT[4]), (2, TEXT[1])]
    got = plain(cp.drop_near_duplicates(spark, make(spark, odd), sf_dir))
    assert [r[:2] for r in got] == sorted([(1, TEXT[0]), (1, TEXT[1]), (None, TEXT[2]), (None, None), (None, None), (4, TEXT[4])], key=str)
    assert [r[3] for r in got if r[1] in (TEXT[1], TEXT[4])] == ["s2", "s8"]


def test_repeat_rows(spark, sf_dir):
    odd = [(1, TEXT[0]), (1, TEXT[0]), (1, TEXT[1]), (None, TEXT[2]), (None, ""), (5, TEXT[2]), (6, TEXT[5])]
    got = plain(cp.cut_repeats(spark, make(spark, odd), sf_dir))
    texts = sorted([(1, TEXT[0]), (1, ""), (1, TEXT[1]), (None, TEXT[2]), (None, ""), (5, ""), (6, TEXT[5])], key=str)
    assert sorted((r[:2] for r in got), key=str) == texts
    assert sorted(r[3] for r in got) == [f"s{n}" for n in range(7)]
    assert all(r[4] == len(r[1]) for r in got)


def test_contaminated_rows(spark, sf_dir):
    odd = [(1, TEXT[0]), (1, TEXT[1] + " " + ITEM), (1, TEXT[0]), (None, TEXT[2]), (None, ITEM + " " + TEXT[3]), (None, None), (2, "")]
    docs = make(spark, odd)
    want = [r for r in plain(docs) if "exam0" not in (r[1] or "")]
    assert plain(cp.drop_contaminated(spark, docs, sf_dir)) == want


def test_packed_rows(spark, sf_dir):
    odd = [(1, TEXT[0]), (1, TEXT[0]), (1, TEXT[1]), (None, TEXT[2]), (None, None), (2, "")]
    got = cp.pack_sequences(spark, make(spark, odd), sf_dir).collect()
    starts = sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.start == 0)
    assert starts == [(False, 1)] * 3 + [(False, 2)] + [(True, 0)] * 2
