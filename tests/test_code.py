"""Symbols, imports and the map of a small repository."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewell.operators import code

FILES = [
    ("src/a.ts", "import { b } from './lib/b.js'\nimport c from \"./c\"\nexport const A = 1\nexport default class Main {}\nexport function* gen() {}\nexport type T = 1\nfunction own() {}\nexport const A = 2\n"),
    ("src/lib/b.ts", "import '../a'\nexport * from '..'\nconst x = require('./b')\nimport('./none')\nexport { y } from \"../c/\"\n"),
    ("src/c/index.ts", "import {\n  q\n} from '../lib/b'\nimport lib from 'lib'\n"),
    ("src/c.py", "from .a import b\nimport os.path\nimport os.path\nclass C:\n    def inner(self): pass\nasync def run():\n"),
    ("main.go", 'package main\nimport "fmt"\nimport (\n  "os"\n  x "./y"\n)\nfunc (s *S) Do() {}\ntype S struct {}\ntype I interface {}\n'),
    ("lib.rs", "use std::io;\npub mod a;\npub fn f() {}\n  pub(crate) async fn g() {}\npub enum E {}\nfn hidden() {}\n"),
    ("App.java", "public abstract class App {}\n  final class In {}\nrecord R() {}\n"),
    ("notes.txt", "class Nothing {}\nimport z from './a'\n"),
    ("empty.ts", ""),
]


def files(spark):
    return spark.createDataFrame([("p", rel, text, len(text), i + 1) for i, (rel, text) in enumerate(FILES)], "project string, rel string, text string, bytes long, mtime long")


def test_symbols(spark):
    got = {}
    for r in code.extract_symbols(files(spark)).orderBy("line").collect():
        got.setdefault(r.rel, []).append((r.symbol, r.line))
    assert got == {
        "src/a.ts": [("A", 3), ("class Main", 4), ("gen()", 5), ("type T", 6), ("own()", 7)],
        "src/c.py": [("class C", 4), ("run()", 6)],
        "main.go": [("Do()", 7), ("struct S", 8), ("interface I", 9)],
        "lib.rs": [("f()", 3), ("g()", 4), ("enum E", 5)],
        "App.java": [("class App", 1), ("class In", 2), ("record R", 3)],
    }


def test_imports_and_graph(spark):
    imports = code.extract_imports(files(spark))
    got = {}
    for r in imports.orderBy("nth").collect():
        got.setdefault(r.rel, []).append(r.spec)
    assert got["src/a.ts"] == ["./lib/b.js", "./c"] and got["src/lib/b.ts"] == ["../a", "..", "./b", "./none", "../c/"]
    assert got["src/c.py"] == [".a", "os.path"] and got["main.go"] == ["fmt", "os", "./y"] and got["lib.rs"] == ["std::io", "a"]
    edges = {(r.rel, r.spec, r.target) for r in code.import_graph(files(spark), imports).collect()}
    # ./c is the stem of c.py before the folder of c/index.ts; '..' and a slash at the end name no file; ./b is the file itself
    assert edges == {("src/a.ts", "./lib/b.js", "src/lib/b.ts"), ("src/a.ts", "./c", "src/c.py"), ("src/lib/b.ts", "../a", "src/a.ts"), ("src/c/index.ts", "../lib/b", "src/lib/b.ts")}


def test_rank_and_map(spark):
    symbols = code.extract_symbols(files(spark))
    ranked = code.repo_rank(files(spark), symbols, code.import_graph(files(spark), code.extract_imports(files(spark))))
    score = {r.rel: r.score for r in ranked.collect()}
    assert score["src/lib/b.ts"] == 2 * 3 + 2 / 9 * 2 and score["main.go"] == 3 * 0.5 + 5 / 9 * 2 + 3
    shown = code.repo_map(ranked, symbols, 40, 2).orderBy("rank").collect()
    assert shown[0].line == "# repo map: p (9 files)\n" and sum(r.tokens for r in shown) <= 40
    assert [r.line for r in shown if r.rel == "src/a.ts"] == [f"  a.ts ({len(FILES[0][1])}b ←1): A, class Main +3\n"]
    whole = code.repo_map(ranked, symbols).collect()
    assert len(whole) == 10


def test_searched_symbols(spark):
    patterns = ["parseLine", r"\bparseLine\b", "function parseLine(", "export async function parseLine\\(a", "^class Parser$", "foo|bar", "abc", "a.*b", "", None, "  const $limit "]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in patterns], "p string").select(code.grep_symbol(F.col("p"))).collect()]
    assert got == ["parseLine"] * 4 + ["Parser"] + [None] * 5 + ["$limit"]


def test_symbol_lookup_takes_the_first_files_of_a_name(spark):
    symbols = spark.createDataFrame([("p", f"f{i}.ts", "parse()", i) for i in range(9)] + [("p", "f0.ts", "class parse", 50), ("q", "a.ts", "class Parser", 1), ("p", "z.ts", None, 1)], "project string, rel string, symbol string, line long")
    searches = spark.createDataFrame([("p", r"\bparse\b"), ("p", r"\bparse\b"), ("p", "class Parser"), ("q", "class Parser"), ("q", None)], "project string, pattern string")
    got = sorted((r.project, r.name, r.nth, r.rel, r.line) for r in code.symbol_lookup(searches, symbols).collect())
    assert got == [("p", "parse", 1, "f0.ts", 0), ("p", "parse", 2, "f1.ts", 1), ("p", "parse", 3, "f2.ts", 2), ("q", "Parser", 1, "a.ts", 1)]
    assert code.symbol_lookup(searches, symbols.limit(0)).count() == 0


def test_map_and_relevant_code_read_written_files_and_symbols(spark):
    """Texts are put together from lineitem, and symbols found in them, once for each query."""
    for name in ("repo_map", "relevant_code", "repo_rank"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan, name
        assert name == "repo_rank" or "interface|struct" not in plan, name
