"""The training-data operators on small inputs with nulls, empty and repeated rows, ties and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tests.harness import compare
from tests.llm.brute import jaccard_components, least_reachable
from tracewell.llm import bpe, chat, html_consensus, line_dedup, mixing, multi_index, multiprobe, ngram_join, pseudo_likelihood, queries, toxicity

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 3000 + "end"
TEXTS = [(1, "One two three four five six seven"), (2, "one two three four five six SEVEN"), (3, None), (4, ""), (5, "a b"), (6, "A\tb"), (7, LONG), (7, LONG), (None, "one two three four five six seven"), (8, " \n\t")]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok <turn user>\n\\c\\"
    rows = [(1, 0, "system", None), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (1, 70, "user", "later"), (1, 71, "assistant", "last"), (2, 0, "us>er\n", "no reply"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    examples = chat.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest_examples(examples).collect()}
    for conv in (1, 2, None):
        own = [(r, t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    one = {r.example: r for r in examples.where("conv_id = 1 and block = 0").collect()}
    assert chat.read_turns(one[3].formatted) == [("system", ""), ("user", hard), ("assistant", hard)]  # all turns before it as context


def test_chat_long_conversation(spark, tmp_path):
    """All turns before a reply are its context, beyond 64 turns, with gaps and negative numbers too."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} <turn x") for i in range(200)] + [(2, i * 50 - 120, "assistant", f"s{i}") for i in range(8)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(con, queries.op1(spark, str(tmp_path)), queries.CHAT_SQL) is None
    examples = chat.prefix_targets(table).collect()
    for r in examples:
        said = chat.read_turns(r.formatted)
        assert said == [(role, text) for c, _, role, text in rows if c == r.conv_id][: len(said)]
    assert sorted(r.context_blocks for r in examples if r.conv_id == 2) == [0, 0, 1, 2, 3, 4, 4, 5]


@pytest.mark.parametrize("hot", [ngram_join.HOT_LIST, 3])
def test_ngram_join_small(spark, hot):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(texts(spark), hot=hot).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 2, 7), (7, 2, 7), (None, 3, 1), (8, 0, 8)], key=str)


def test_ngram_join_against_all_pairs(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = jaccard_components(list(zip(t["doc_id"], t["text"])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want


def test_ngram_join_keeps_links_far_from_the_leader(spark):
    """Linked pairs of about 0.37 to their leader, whose own copies are the main component of every list that they share."""
    g, rows, pools = np.random.default_rng(2), [], []
    for f in range(80):
        lead, pool = [f"l{f}x{i}" for i in range(57)], [f"p{f}x{i}" for i in range(24)]
        rows += [lead + [f"u{f}x{c}x{i}" for i in range(3)] for c in range(4)]
        order = g.permutation(57).tolist()
        held, pools = order[:34], [*pools, *pool, *[lead[i] for i in order[34:]]]
        rows += [[lead[i] for i in held] + pool + [f"o{f}x{c}x{i}" for i in range(4)] for c in range(2)]
    rows += [pools + [f"f{k}x{i}" for i in range(3000)] for k in range(8)]  # makes all but what the leader shares frequent, links with nothing
    sets = [set(r) for r in rows]
    links = [(a, b) for a in range(480) for b in range(a // 6 * 6, a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_reachable(range(len(rows)), links)
    assert all(want[k + 5] == k + 4 and want[k + 3] == k for k in range(0, 480, 6))
    got = ngram_join.link_documents(texts(spark, [(i, " ".join(r)) for i, r in enumerate(rows)]), n=1).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_ngram_join_links_behind_two_leaders(spark):
    """Two short sets like nothing and two longer ones like each other, their lists cut in parts: where a part holds
    one of each, the short ones lead, and the list of these two leaders has to open the pair behind them."""
    g, rows = np.random.default_rng(7), []
    for f in range(40):
        core = [f"c{f}x{i}" for i in range(60)]
        rows += [g.permutation(core)[: int(g.integers(42, 46))].tolist() for _ in range(2)]
        rows += [core + [f"s{f}x{k}x{i}" for i in range(int(g.integers(2, 8)))] for k in range(2)]
    common = [w for r in rows for w in r if w[0] == "c"]
    rows += [common + [f"f{k}x{i}" for i in range(6000)] for k in range(4)]  # makes every word frequent, links with nothing
    sets = [set(r) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a // 4 * 4, a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_reachable(range(len(rows)), links)
    got = ngram_join.link_documents(texts(spark, [(i, " ".join(r)) for i, r in enumerate(rows)]), n=1, hot=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_ngram_join_bitmaps_bound_the_difference(spark):
    g, rows, apart = np.random.default_rng(5), [], []
    for size, other in [(1, 1), (3, 4), (60, 70), (64, 65), (100, 129), (500, 520), (40, 1000)]:
        for same in (0, size // 2, size - 1, size):
            x = g.integers(0, 2**63, other, np.uint64)
            y = np.unique(np.append(x[:same], g.integers(0, 2**63, size - same, np.uint64)))
            rows.append([ngram_join._bitmap(z).tolist() for z in (np.unique(x), y)])
            apart.append((len(np.setxor1d(x, y)), len(x) + len(y)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<bigint>, b array<bigint>")
    for i, one, two in df.select("i", ngram_join._apart(df.a, df.b), ngram_join._apart(df.b, df.a)).collect():
        assert one == two <= apart[i][0] and one % 2 == apart[i][0] % 2
        assert one > 0.2 * apart[i][1] or apart[i][0] < 0.9 * apart[i][1] or i >= 24  # a small and a large set fold to few bits


def test_ngram_join_moves_no_text_of_sets_far_apart(spark, monkeypatch):
    """Pairs that share nothing but their rarest word, and one linked pair, whose texts alone are verified."""
    moved, verified = [], ngram_join._verified

    def counted(docs, pairs, *args, **kwargs):
        moved.append(pairs.count())
        return verified(docs, pairs, *args, **kwargs)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rows = [[f"u{i}x{j}" for j in range(30)] + [f"s{i // 2}"] for i in range(40)]
    common = [w for r in rows for w in r[:30]]
    rows += [rows[0][:30] + ["t"]] + [common + [f"f{k}x{i}" for i in range(6000)] for k in range(4)]
    got = ngram_join.link_documents(texts(spark, [(i, " ".join(r)) for i, r in enumerate(rows)]), n=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(45)} | {40: 0}
    assert sum(moved) == 1


def test_mix_targets_and_limits(spark):
    rows = [(i, "w " * (i % 7 * 40), s) for i, s in enumerate(["b"] * 30 + ["a"] * 5 + [None] * 9)] + [(0, None, "b"), (0, None, "b"), (None, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"block_words": 50, "levels": 2}
    kept, segments = mixing.mix(docs, **how)
    kept, segments = kept.collect(), segments.collect()
    assert len(kept) == len(rows)
    size, target, taken, by_doc, seen = Counter(), {}, Counter(), Counter(), set()
    for r in kept:
        size[r.nth] += r.size
        target[r.nth] = r.target
    for s in segments:
        taken[s.nth] += s.to_word - s.from_word
        by_doc[s.nth, s.slice, s.rn] += s.to_word - s.from_word
        assert (s.nth, s.slice, s.rn, s["pass"], s.block) not in seen
        seen.add((s.nth, s.slice, s.rn, s["pass"], s.block))
    assert {n: int(t) for n, t in target.items()} == dict(taken)
    assert all(by_doc[r.nth, r.slice, r.rn] <= 3 * r.size for r in kept)
    weight, left, free, want = {n: n % 3 + 1 for n in size}, float(sum(size.values())), set(size), {}
    while over := [n for n in free if left * weight[n] / sum(weight[k] for k in free) > 3 * size[n]]:
        for n in over:
            want[n] = 3.0 * size[n]
        left = sum(size.values()) - sum(want.values())
        free -= set(over)
    want |= {n: left * weight[n] / sum(weight[k] for k in free) for n in free}
    assert target == pytest.approx(want)
    again = mixing.mix(docs, **how)[1].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, segments))
    words = sum(len((r.text or "").split()) for r in mixing.mixed_texts(docs, **how).collect())
    assert words == sum(taken.values())


def test_noisy_or_finds_the_sentence(spark):
    rows = [(i, ("A calm line. You idiot fool. More calm." if i % 3 == 0 else "A calm line. Nice weather now. More calm.")) for i in range(90)] + [(None, None), (200, ""), (200, "")]
    docs = texts(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert len(got) == 93
    for r in got:
        toxic = r.text is not None and "idiot" in r.text
        assert r.predicted == int(toxic) and 0 <= r.score <= 1
        assert [r.text[o.start : o.end].strip() for o in r.offending] == (["You idiot fool"] if toxic else [])
    no_labels = toxicity.train_toxicity(docs, labels.where("doc_id > 1000"))
    assert toxicity.score_toxicity(docs, no_labels).where("predicted = 1").count() == 0


def test_line_dedup_small(spark):
    line = "This line is repeated everywhere"
    rows = [(1, f"{line}\nown one\n{line}"), (2, f"  {line.upper()}\t\nown"), (3, f"a\n{line}\n\n{line}"), (3, f"{line}"), (4, "short\nshort"), (5, "short"), (6, "short"), (7, None), (None, line)]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped, list(r.runs)) for r in line_dedup.dedup_lines(texts(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "own one", 3, 2, [0, 1, 1, 1]), (2, "own", 2, 1, [0, 1, 1]), (3, f"a\n{line}\n\n{line}", 4, 0, [4]), (3, line, 1, 0, [1]), (4, "short\nshort", 2, 0, [2]), (5, "short", 1, 0, [1]), (6, "short", 1, 0, [1]), (7, "", 1, 0, [1]), (None, "", 1, 1, [0, 1])], key=str)


def test_html_consensus_small(spark):
    page = "<title>t</title><body><nav>menu</nav><div class='col-{0}'><p>Tom &amp; <b>Je</b>rry\n {1}</p><div class=ad>buy</div><form>f</form></div><div class='comments'>c {2}</div><footer>f</footer>"
    rows = [(i, "http://h.example/x", page.format(i, "long text " * 20, "")) for i in range(4)] + [(8, "http://h.example/y", page.format(9, "few", "much " * 99)), (9, None, "<p>alone</p>"), (10, "http://h.example/z", None), (None, "x", "")]
    got = {r.page_id: r for r in html_consensus.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == " ".join(("Tom & Jerry " + "long text " * 20).split()) and got[0].n_chars == len(got[0].text)
    assert (got[8].text, got[9].text, got[10].text, got[None].text) == ("Tom & Jerry few", "alone", "", "")


def test_html_consensus_keeps_lead_and_body(spark):
    lead, body, links = "The lead says it all. ", "The body goes on at length. ", "".join(f"<a href='/{i}'>another story {i}</a> " for i in range(40))
    wrapped = f"<main><div class=links>{links}</div><article class='post with-share'><div class=inner><div class=lead><p>{lead * 4}</p></div><div class='text has-comments'><p>{body * 12}</p></div></div><div class=share>tell</div></article></main>"
    plain = f"<div id=page><div class='entry'><div class=top><p>{lead * 4}</p></div><div class='entry-text'><section><div><p>{body * 12}</p></div></section></div></div></div>"
    boxed = f"<div class=main><div class=more>{links * 2}</div><div class=post><p>{body * 12}</p></div></div>"
    rows = [(h * 10 + i, f"http://{h}.example/{i}", f"<body><nav>{links}</nav>{page}<footer>end</footer>") for h, page in enumerate((wrapped, plain, boxed)) for i in range(3)]
    both, alone = " ".join((lead * 4 + body * 12).split()), " ".join((body * 12).split())
    got = {r.page_id: r.text for r in html_consensus.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: alone if k >= 20 else both for k, _, _ in rows}


def test_bpe_equals_the_library(spark):
    t = bpe._tokenizer(TOKENIZER)
    hard = [(100, "<|endoftext|>x <|startoftext|> y"), (101, "ΣΑΣ İstanbul é ́x it's they'll a1b2 !!! 日本語 👩‍👩‍👧 z\u0085y")]
    for r in bpe.encode_documents(texts(spark, TEXTS + hard), TOKENIZER, texts=True).collect():
        text = dict(TEXTS + hard)[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded == t.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == sha(r.decoded)


def test_pseudo_likelihood_prefers_real_order(spark):
    rows = [(i, "the cat sat on the mat and the dog lay by the door " * 20) for i in range(8)] + [(100, "cat the mat on dog the the door lay and by sat " * 20), (7, None), (None, "the")]
    docs = texts(spark, rows)
    got = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs.where("doc_id < 8"), rounds=3, stride=1)).collect()
    mean = {r.doc_id: r.mean_log_likelihood for r in got if r.n_tokens}
    assert mean[0] > mean[100] + 0.5
    assert [(r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for r in got if r.doc_id == 7 and not r.n_tokens] == [(0, 0.0, None)]
    w = pseudo_likelihood.unpack(pseudo_likelihood.first_weights(np.ones(pseudo_likelihood.GAP), 1))
    flat = np.array([pseudo_likelihood.GAP] * 2 + [5, 6, 7] + [pseudo_likelihood.GAP] * 2)
    other = flat.copy()
    other[3] = 9
    at = np.array([3])
    assert (pseudo_likelihood._hidden(w, flat, at) == pseudo_likelihood._hidden(w, other, at)).all()  # a word does not see itself


def test_pseudo_likelihood_step_follows_the_gradient():
    p = pseudo_likelihood
    g = np.random.default_rng(3)
    flat = np.concatenate([[p.GAP] * 2, g.integers(0, p.GAP, 60), [p.GAP] * 2])
    at = np.arange(2, 62)
    start = p.first_weights(g.integers(1, 99, p.GAP), 3)
    # plain softmax over classes and members, place by place
    w = {k: v.astype(np.float64) for k, v in p.unpack(start).items()}
    want = []
    for i in at:
        h = np.tanh(sum(w["near"][k][flat[i + o]] for k, o in enumerate(p.OFFSETS)))
        c, m = divmod(flat[i], p.MEMBERS)
        x, y = h @ w["classes"] + w["class_bias"], h @ w["members"][c] + w["member_bias"][c]
        want.append(x[c] - np.log(np.exp(x).sum()) + y[m] - np.log(np.exp(y).sum()))
    assert np.allclose(p.log_probabilities(p.unpack(start), flat, at), want, atol=1e-5)
    # numeric gradient of the mean loss in some weights of each array
    own = start.copy()
    room, sums = p.unpack(np.zeros_like(own)), p.unpack(np.full_like(own, 1e-3))
    p.train_step(p.unpack(own), room, sums, flat, at)
    loss = lambda f: -p.log_probabilities(p.unpack(f), flat, at).mean()
    for name, x in room.items():
        j = np.unravel_index(np.abs(x).argmax(), x.shape)
        up, down = start.copy(), start.copy()
        p.unpack(up)[name][j] += 1e-2
        p.unpack(down)[name][j] -= 1e-2
        assert x[j] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.02, abs=1e-4), name
    assert loss(own) < loss(start)


def test_pseudo_likelihood_step_leaves_other_words_alone():
    """Rows of words that are no neighbour in a batch are not written at all, those of the others follow Adagrad."""
    p = pseudo_likelihood
    g = np.random.default_rng(4)
    flat = np.concatenate([[p.GAP] * 2, g.integers(0, 50, 300), [p.GAP] * 2])
    own = p.first_weights(np.ones(p.GAP), 4)
    w, room, sums = p.unpack(own), p.unpack(np.zeros_like(own)), p.unpack(np.full_like(own, 1e-3))
    sums["near"][:, 100:-1] = -1  # has no root
    with np.errstate(invalid="raise"):
        for _ in range(2):
            before, squares = own.copy(), {k: x.copy() for k, x in sums.items()}
            p.train_step(w, room, sums, flat, np.arange(2, 302))
            for name, x in room.items():
                here = slice(None) if name != "near" else (slice(None), [*range(100), p.GAP])
                s = squares[name][here] + x[here] ** 2
                assert np.allclose(sums[name][here], s) and np.allclose(w[name][here], p.unpack(before)[name][here] - p.RATE * x[here] / (np.sqrt(s) + 1e-6), atol=1e-6)
    assert not room["near"][:, 60:-1].any()


def test_pseudo_likelihood_of_rare_words(spark):
    numbers = pseudo_likelihood._Numbers([])
    a, b, unseen = [w for i in range(400) if numbers[(w := f"r{i}").encode()] == numbers[b"r0"]][:3]
    docs = texts(spark, [(1, " ".join(f"w{i}" for i in range(992)) + " ") for _ in range(5)] + [(2, a), (3, f"{a} {a} {a}"), (4, b), (5, unseen)])
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, pseudo_likelihood.train(docs.where("doc_id < 5"), rounds=1)).collect()}
    assert got[2].log_likelihood - got[4].log_likelihood == pytest.approx(np.log(4))  # seen 4 times and once, in one bucket
    assert got[5].log_likelihood == pytest.approx(got[4].log_likelihood)
    whole = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.train_and_score(docs, rounds=1).collect()}
    assert whole == {r.doc_id: r.log_likelihood for r in pseudo_likelihood.score(docs, pseudo_likelihood.train(docs, rounds=1)).collect()}
    assert pseudo_likelihood.STRIDE == 1  # every word is a training target


def vectors(spark, n=300, dim=8):
    g = np.random.default_rng(1)
    x = g.standard_normal((n, dim)).astype(np.float32)
    x[50:60] = x[50] * (1 + 1e-4 * g.standard_normal((10, 1)).astype(np.float32))
    x[70] = x[71]
    rows = [(i, v.tolist(), i % 2 if i < 280 else None) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, [None] * dim, 1), (904, [1.0, 2.0], 1), (900, None, 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def test_multiprobe_recall(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "BUCKET", 16)
    x, df = vectors(spark)
    got = defaultdict(list)
    for r in multiprobe.nearest(df, df.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    far = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    hit = 0
    for q in range(0, 300, 10):
        order = [i for i in np.lexsort((np.arange(300), far[q])) if i != q][:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(far[q][i]) for i, s in got[q])
        hit += len(set(order) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 300 and 900 not in got and 904 not in got


def test_multiprobe_blocks_return_no_more_than_the_own_buckets_leave_open(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "BUCKET", 16)
    returned, nearest = [], multiprobe._nearest
    monkeypatch.setattr(multiprobe, "_nearest", lambda *args: (returned.append(nearest(*args)), returned[-1])[1])
    x, df = vectors(spark, n=2000)
    got = multiprobe.nearest(df, df.where("vec_id % 100 = 0 and vec_id < 900")).collect()
    far = np.sqrt(((x[:900:100, None].astype(float) - x[None]) ** 2).sum(2))
    assert len(got) == 90 and sum(r.score <= np.sort(far[r.query_id // 100])[10] for r in got) >= 81
    assert sum(df.count() for df in returned) < 90 * multiprobe.TABLES * 5


def test_multiprobe_repeated_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(1, [1.0, 1.0])] * 12 + [(2, [2.0, 1.0 + j / 100]) for j in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multiprobe.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, float(i)) for i in range(1, 11)]


def test_multiprobe_fit_says_what_it_misses():
    sample = np.random.default_rng(1).standard_normal((300, 32))
    assert not multiprobe.fit(sample, 8, 1, 10, 0.97, 5)[2] and multiprobe.fit(sample, 0, 1, 10, 0.97, 5)[2]


def test_multi_index_links(spark):
    x, df = vectors(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(a, b) for a in range(280) for b in range(a) if a % 2 == b % 2 and u[a] @ u[b] >= 0.98]
    least, n = least_reachable(range(300), links), Counter(i for pair in links for i in pair)
    got = multi_index.near_copies(df, recall=1.0, codewords=4).collect()
    assert len(got) == 306
    for r in got:
        assert (r.n_links, r.component_id) == ((n[r.vec_id], least[r.vec_id]) if r.vec_id < 300 else (0, r.vec_id))
        assert r.kept == (r.vec_id == r.component_id)


def test_multi_index_towards_codewords(spark):
    """Pairs that differ along the directions between codewords are linked at the default recall."""
    g = np.random.default_rng(4)
    x = g.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = multi_index.codebook(x[:, :32], 16, 3)
    own = multi_index.needs(x[:, :32], book)[0]
    y = np.empty_like(x)
    for i in range(len(x)):
        d = np.concatenate([book[(own[i] + 1 + g.integers(15)) % 16] - book[own[i]], np.zeros(32)])
        d -= d @ x[i] * x[i]
        y[i] = 0.981 * x[i] + np.sqrt(1 - 0.981**2) * d / np.linalg.norm(d)
    z = np.concatenate([x, y])
    near = z @ z.T >= 0.98
    np.fill_diagonal(near, False)
    least = least_reachable(range(1200), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    got = multi_index.near_copies(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(z)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()), least[i]) for i in range(1200)}


def test_empty_tables(spark):
    none = texts(spark, [])
    assert chat.digest_examples(chat.prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert ngram_join.link_documents(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"))[1].count() == 0
    assert toxicity.train_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))["weights"] == {}
    assert html_consensus.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert bpe.encode_documents(none, TOKENIZER).count() == 0
    assert pseudo_likelihood.score(none, pseudo_likelihood.train(none, rounds=1)).count() == 0
    no_vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multiprobe.nearest(no_vectors, no_vectors).count() == 0
    assert multi_index.near_copies(no_vectors).count() == 0


def test_extra_columns_stay(spark):
    from pyspark.sql import functions as F

    docs = texts(spark).withColumns({c: F.lit("mine") for c in ("sig", "size", "h", "runs", "score", "word", "block", "source")})
    kept = line_dedup.dedup_lines(docs)
    assert kept.where("sig = 'mine' and size = 'mine'").count() == len(TEXTS)
    assert ngram_join.link_documents(docs).count() == len(TEXTS)
    assert mixing.mixed_texts(docs).where("h = 'mine'").count() > 0
    assert re.match("mine", toxicity.score_toxicity(docs, {"weights": {}, "bias": -20.0, "leak": -3.0}).first().sig)
