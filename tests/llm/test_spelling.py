"""Spelling variants against all pairs of small vocabularies."""

import random
import re
import zlib
from collections import Counter

import pytest

from tracewell.llm import spelling


def one_edit(a, b):
    """True if exactly one code point is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x.encode()), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def corpus(seed):
    """Words with chains of edits, of all lengths, tied counts, upper case and letters beyond ASCII."""
    r = random.Random(seed)

    def edit(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcÀ") + w[i:], w[:i] + r.choice("abcÀ") + w[i + 1 :]])

    words = []
    for size in (6, 6, 7, 8, 9, 15, 32, 33, 34, 40, 70):
        base = "".join(r.choice("abcdé") for _ in range(size))
        first = [edit(base) for _ in range(12)]
        words += [base] * 200 + [w for w in first + [edit(w) for w in first] for _ in range(r.choice([3, 5, 8, 30, 60]))]
    r.shuffle(words)
    rows = [(i or None, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    rows = [(i, t.title() if i and i % 3 else t) for i, t in rows]
    return rows + [(7, None), (8, "")] + [(9, "A" * 30_000 + " 1x1 " + "B" * 5_000)] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'k' AS key")
    got = [(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.spelling_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
