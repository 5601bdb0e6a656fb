"""Files and symbols that fit a prompt."""

import math

from tests.test_code import files
from tracewell.operators import code, hints


def ask(spark, *texts, **kw):
    df = files(spark)
    symbols = code.extract_symbols(df)
    prompts = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("other", 99, "the Main class")], "project string, query_id int, text string")
    edges = code.import_graph(df, code.extract_imports(df))
    return symbols, hints.relevant_code(prompts, df, symbols, edges, **kw)


def test_named_files_and_symbols(spark):
    _, got = ask(spark, "open notes in the lib", "why does App fail", "where is interface handled", "", None, "annotated notesbook")
    rows = {(r.query_id, r.nth): r for r in got.collect()}
    # a file's name counts as a whole word only; short symbol names are not named
    assert rows[0, 1].rel == "notes.txt" and rows[0, 1].symbols == [] and {k[0] for k in rows} <= {0, 1}


def test_two_terms_uses_and_what_was_shown(spark):
    symbols, got = ask(spark, "change gen and own of src/a.ts")
    first = got.where("nth = 1").first()
    assert first.rel == "src/a.ts" and [(s.symbol, s.line) for s in first.symbols] == [("gen()", 5), ("own()", 7)]
    assert list(first.uses) == ["src/c.py", "src/lib/b.ts"]
    shown = spark.createDataFrame([(0, "src/a.ts", s.symbol) for s in first.symbols] + [(0, "src/a.ts", None)], "query_id int, rel string, symbol string")
    again = ask(spark, "change gen and own of src/a.ts", shown=shown)[1].where("rel = 'src/a.ts'").collect()
    assert not again or not {s.symbol for s in again[0].symbols} & {s.symbol for s in first.symbols}


def test_scores_equal_a_scan_of_all_docs(spark):
    text = "change Main and gen of src/a.ts and lib"
    df = files(spark)
    symbols = code.extract_symbols(df)
    prompts = spark.createDataFrame([("p", 0, text)], "project string, query_id int, text string")
    got = {(r.rel, r.symbol): (round(r.score, 9), r.matched, round(r.coverage, 9)) for r in hints.code_ranked(prompts, df, symbols).collect()}
    docs = {(r.rel, r.symbol): r for r in hints._docs(df, symbols).collect()}
    terms = ["change", "main", "gen", "src/a.ts", "src", "lib"]
    mean = sum(len(d.text) for d in docs.values()) / len(docs)

    def times(t, term):
        return min(20, t.count(term)) if len(term) > 3 else min(20, sum(1 for i in range(len(t)) if t.startswith(term, i) and (i == 0 or not t[i - 1].isalnum())))

    idf = {}
    for t in terms:
        n = sum(times(d.text, t) > 0 for d in docs.values())
        idf[t] = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
    want = {}
    for key, d in docs.items():
        f = {t: times(d.text, t) for t in terms if times(d.text, t)}
        if f:
            named = len(d.name) >= 5 and d.name in text.lower() if key[1] else len(d.name) >= 4 and d.name in text.lower().split()
            s = sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d.text) / mean)) for t, n in f.items())
            want[key] = (round(s * (3 if named else 1 if key[1] else 0.8), 9), len(f), round(sum(idf[t] for t in f) / sum(idf.values()), 9))
    assert got == want
