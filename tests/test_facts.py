"""Facts of a session against the hand-made golden, quotes, and keeping the first of similar texts by brute force."""

import random

from pyspark.sql import functions as F

from tracewell.operators import facts, similar

SCHEMA = "session_id string, seq long, block int, type string, block_type string, text string, tool string, tool_id string, command string, result_id string, is_error boolean, result string"


def entry(seq, role, *parts):
    out = []
    for i, p in enumerate(parts):
        row = dict(session_id="s", seq=seq, block=i, type=role)
        out.append(row | (dict(block_type="text", text=p) if isinstance(p, str) else p))
    return out


def bash(i, command):
    return dict(block_type="tool_use", tool="Bash", tool_id=i, command=command)


def result(i, text, is_error=False):
    return dict(block_type="tool_result", result_id=i, result=text, is_error=is_error)


def table(spark, entries):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for e in entries for r in e], SCHEMA)


def test_golden(spark):
    talk = [
        entry(0, "user", "Please always use pnpm in this repo, never npm."),
        entry(1, "assistant", "Let me run the tests.", bash("b1", "pnpm test")),
        entry(2, "user", result("b1", "FAILED src/cart.test.ts\nexit code 1", True)),
        entry(3, "assistant", "The failure happens because the cart total is rounded before tax is applied. We chose to round only at checkout to match the invoice service.", bash("b2", "pnpm test")),
        entry(4, "user", result("b2", "Tests 42 passed")),
        entry(5, "assistant", bash("b3", "export API_TOKEN=abc123 && pnpm run deploy")),
        entry(6, "user", result("b3", "ok")),
    ]
    got = [(r.kind, r.text, r.standing) for r in facts.extract_facts(table(spark, talk)).orderBy("rank").collect()]
    assert got == [
        ("preference", "User preference: Please always use pnpm in this repo, never npm.", True),
        ("cause", "Root cause: The failure happens because the cart total is rounded before tax is applied.", False),
        ("decision", "We chose to round only at checkout to match the invoice service.", False),
        ("command", "Command that works here: `pnpm test`", False),
    ]


def test_near_a_failure_caps_and_order(spark):
    """A cause long after the failure does not count unless it says so; the newest stay; fixed commands lead."""
    talk = [entry(0, "assistant", bash("a", "make build"), bash("b", "cd /x && cargo test"), bash("c", "go vet ./..."))]
    talk += [entry(1, "user", result("a", "ok"), result("b", "exit code 2"), result("c", "fine"))]
    talk += [entry(2, "assistant", bash("d", "cargo test")), entry(3, "user", result("d", "passed"))]
    talk += [entry(13, "assistant", "This fails because the lock is held by another thread here.")]
    talk += [entry(14, "assistant", "That fails because the socket was closed too early by us.", "The root cause is a missing flush in the writer loop.")]
    talk += [entry(20 + i, "assistant", f"We decided on {w}.") for i, w in enumerate(["a queue for mail", "one table per client", "small files in folders", "no cache at all today"])]
    talk += [entry(30, "assistant", 'The words "we decided to" and "root cause" are triggers in this tool.')]
    got = [(r.kind, r.text) for r in facts.extract_facts(table(spark, talk)).orderBy("rank").collect()]
    assert [t for k, t in got if k == "cause"] == ["Root cause: This fails because the lock is held by another thread here.", "Root cause: The root cause is a missing flush in the writer loop."]
    assert [t.split()[3:5] for k, t in got if k == "decision"] == [["one", "table"], ["small", "files"], ["no", "cache"]]
    assert [t for k, t in got if k == "command"] == ["Command that works here: `cargo test`", "Command that works here: `make build`"]
    assert facts.extract_facts(table(spark, [])).collect() == []


def test_quotes(spark):
    rows = [('say "root cause" now', True), ("root cause found", False), ('"root cause" and root cause', False), ("nothing", False), ('Root cause: a "root cause" line', True)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert all(r.want == r.got for r in df.select("want", facts.quoted_only(F.col("s"), "(?i)root cause").alias("got")).collect())


def test_first_similar_by_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(r.randrange(3), i, sorted(set(r.choices(words, k=r.randint(0, 7))))) for i in range(250)]
    want = {}
    kept = []
    for g, i, ws in rows:
        like = [j for h, j, xs in kept if h == g and ws and xs and len(set(ws) & set(xs)) / len(set(ws) | set(xs)) >= 0.6]
        if like:
            want[i] = min(like)
        else:
            want[i] = i
            kept.append((g, i, ws))
    got = similar.first_similar(spark.createDataFrame(rows, "g int, id long, words array<string>"), ["g"], 0.6)
    assert {x.id: x.first for x in got.collect()} == want


def test_similar_pairs_compare_numbers(spark):
    """Pairs by brute force, of sets numbered by how rare their words are; words themselves join nothing."""
    r = random.Random(7)
    rows = {(r.randrange(2), tuple(sorted({f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 9))}))): i for i in range(300)}
    rows = [(g, i, list(ws)) for (g, ws), i in rows.items()]
    sets = spark.createDataFrame(rows, "g int, id long, words array<string>")
    like = lambda x, y: len(x & y) / len(x | y) >= 0.6
    want = {(g, i, j) for g, i, x in rows for h, j, y in rows if g == h and i < j and like(set(x), set(y))}
    got = similar.similar_pairs(sets, ["g"], 0.6)
    assert {tuple(p) for p in got.collect()} == want and want
    assert "words" not in got._jdf.queryExecution().optimizedPlan().toString()
