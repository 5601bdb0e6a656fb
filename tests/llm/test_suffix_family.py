"""Repeated byte strings against all strings of small corpora."""

import random
from collections import Counter

import pytest

from tracewell.llm import suffix_family

WORDS = random.Random(3)
VOCABULARY = ["".join(WORDS.choice("abcdeé") for _ in range(WORDS.randint(1, 7))) for _ in range(60)]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus(seed):
    """Texts that share passages, whole and cut, beside nulls, empty and short texts, copies, runs of one letter."""
    r = random.Random(seed)
    shared = [prose(r, r.randint(3, 40)) for _ in range(8)]
    rows = [(i, " ".join(r.choice([prose(r, r.randint(1, 30)), r.choice(shared), r.choice(shared)[r.randint(0, 10) :]]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    return rows + [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1]), (None, rows[5][1]), (503, "ab" * 300), (504, "x" * 500), (505, prose(r, 3000)), (506, "z" * 41)]


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        out[doc_id, len(t), sum(gone), spans, bytes(b for b, x in zip(t, gone) if not x)] += 1
    return out


def found(docs, **how):
    rows = suffix_family.remove_repeats(docs, **how).collect()
    return Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("length, key, wide, batches", [(40, 16, 10_000, 5), (40, 16, 2, 2), (60, 50, 3, 1), (200, 64, 10_000, 3)])
def test_against_all_strings(spark, length, key, wide, batches):
    rows = corpus(length + wide)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ref", "'x' AS key").repartition(5)
    assert found(docs, length=length, key=key, wide=wide, batches=batches) == brute(rows, length)


def test_long_text_in_parts(spark, monkeypatch):
    """A text longer than a chunk is read in parts; strings across the cuts are found."""
    monkeypatch.setattr(suffix_family, "CHUNK", 1000)
    import pyarrow as pa

    r = random.Random(9)
    text = prose(r, 2000)
    parts = [(bytes(d[a:z]), s) for d, _, skip, starts, stops in suffix_family._pieces(pa.array(["", text, "tail" * 80]), 200) for s, a, z in zip(skip, starts, stops)]
    whole = {(s + i, p[i : i + 200]) for p, s in parts for i in range(len(p) - 199)}
    data = text.encode()
    assert {(i, data[i : i + 200]) for i in range(len(data) - 199)} <= whole


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == Counter()
