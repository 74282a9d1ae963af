"""The prefix trie, periodic runs and chat formatting against plain versions, and awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetra.llm import chat, prefix_trie, queries, runs

SF = "/root/testdata/sf0.001"
CONV = "conv_id bigint, turn bigint, role string, text string, depth int, key string, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(rows, spliced=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    convs = {c: [v for _, v in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if spliced else 0
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, kids = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        under = [below(k) for k in kids.get(p, [])]
        return sum(u[0] for u in under) or 1, sum(u[1] for u in under) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(2)
    rows = [(c, rnd.choice([t, t, None, 1]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a b", "a", "", None, " x\ty ", "é ", "long " * 50])) for c in rnd.sample(range(-45, 130), 110) for t in range(rnd.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(3)]  # one conversation of many ids
    return rows + [(None, 1, "user", "x")] * 3 + [(7777, 0, "user", "rep")] * 4


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "b") for r in rows], CONV).repartition(3)


def test_trie_against_brute_force(spark, talks):
    df = frame(spark, talks)
    for got, want in ((prefix_trie.spliced_trie(df), plain_trie(talks)), (prefix_trie.prefix_trie(df), plain_trie(talks, spliced=False))):
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert prefix_trie.spliced_trie(df.limit(0)).collect() == [] and prefix_trie.prefix_trie(df.where("conv_id is null")).collect() == []


def test_small_and_large_subtrees_agree(spark, talks):
    """Whatever counts as small: all peeled in rounds, one small subtree a sequence, or most in tasks; deep ones among them."""
    rows = talks + [(2000 + c, t, "user", f"deep {t if t < 9 else t * c}") for c in range(3) for t in range(20)]
    chains = prefix_trie.chained(prefix_trie.sequences(prefix_trie.turn_digests(frame(spark, rows)))).cache()
    want = plain_trie(rows, spliced=False)
    for rows_at_most, levels in ((0, 0), (2, 9), (256, 1 << 18)):
        assert sorted(map(tuple, prefix_trie.peeled(chains, rows_at_most, levels).collect()), key=str) == want


def test_trie_nodes_have_their_turns(spark, talks):
    rows = [r for r in talks if r[0] is not None and r[0] >= 1000]
    df = frame(spark, rows)
    got = {(r.conv_id, r.depth): (r.role, r.text) for r in prefix_trie.last_turns(prefix_trie.prefix_trie(df), df).collect()}
    assert got[(1000, 2)] == ("user", "same 1") and got[(1000, 0)] == (None, None) and got[(7777, 4)] == ("user", "rep")


def test_a_shared_end_is_told_over_many_tasks():
    """Ids of one end come in pieces, and the pieces' digest is that of all ids."""
    import pyarrow as pa

    ids = list(range(-5, 200_000))
    batches = [pa.RecordBatch.from_arrays([pa.array([b"t"] * len(x)), pa.array(x)], names=["tip", "conv_id"]) for x in (ids[:70_000], ids[70_000:])]
    pieces = list(prefix_trie._pieces(iter(batches)))
    assert sum(p.num_rows for p in pieces) == 4
    (one,) = [r for b in prefix_trie._digests(iter(pieces)) for r in b.to_pylist()]
    assert one == {"least": -5, "n_convs": len(ids), "ends_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_chat"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got, want = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def plain_runs(w, least=6, power=4):
    got = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                got.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in got.items())


def loops(rnd, pieces):
    out = []
    for _ in range(rnd.randint(0, pieces)):
        unit = [rnd.randrange(rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(1, 9))]
        out += unit * rnd.randint(1, 8) + unit[: rnd.randint(0, len(unit))]
    return out


def test_runs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        texts = [loops(rnd, 5) for _ in range(rnd.randint(1, 6))]
        texts += [list(t) for t in texts] if rnd.random() < 0.5 else []
        want, begin = [], 0
        for t in texts:
            want += [(a + begin, b + begin, q) for a, b, q in plain_runs(t)]
            begin += len(t)
        assert runs.runs(np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts])) == sorted(want)


def test_runs_of_hostile_texts():
    assert runs.runs(np.zeros(100_000, np.int64), np.array([100_000])) == [(0, 100_000, 1)]
    assert runs.runs(np.tile(np.arange(5000), 5), np.array([25_000])) == [(0, 25_000, 5000)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    assert runs.runs(np.array(b), np.array([len(b)])) == plain_runs(b) == [] and runs.runs(np.array(thue), np.array([4096])) == []


def test_grammar_holds_the_texts():
    """Each rule's places hold the same words, and no pair is left twice in what remains."""
    rnd = random.Random(4)
    texts = [loops(rnd, 6) for _ in range(6)] * 2
    ids, ends = np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts])
    g = runs.repair(ids, ends)
    for k in range(len(g.length)):
        words = {tuple(ids[p : p + g.length[k]]) for p in g.place[g.rule == k]}
        assert len(words) == 1 and 0 < g.left[k] < g.length[k]
    assert len(g.first) + len(g.rule) == len(ids)


def plain_report(doc_id, text):
    w = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    top = min(((a - b, a, q) for a, b, q in found), default=None)
    tell = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return doc_id, len(found), *tell, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_run_report_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in loops(rnd, 8)), "r") for i in range(150)] + [(None, "a " * 30, "r"), (5, None, "r"), (6, " \n ", "r"), (7, "é \u00a0x " * 9, "r"), (7, "é \u00a0x " * 9, "r"), (8, "v" * 100_000, "r"), (-3, "a b " * 7 + "z", "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    assert sorted(map(tuple, runs.run_report(df).collect()), key=str) == sorted((plain_report(i, t) for i, t, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, _ in rows if i is not None)
    assert runs.run_report(df.limit(0)).count() == 0
    told = runs.periodic_runs(df.where("doc_id = -3")).first()
    assert [tuple(r) for r in told.runs] == [(0, 14, 2)] and told.collapsed == "a b z" and told.n_words == 15


def test_run_report_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [plain_report(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    got = {r[0]: tuple(r) for r in queries.op12_runs(spark, SF).collect()}
    assert len(got) == docs.count() and all(got[w[0]] == w for w in want) and sum(w[1] for w in want) > 0


PARTS = ["\\", "### ", "</turn>", ": ", "\n", "a", "#", "### Assistant: ", "</turn", "\\### ", ""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=5).map("".join), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=5))
def test_any_conversation_comes_back(turns):
    told = [chat.render(role, text) for role, text in turns]
    whole = "".join(t[0] for t in told)
    assert [t[:2] for t in chat.parse(whole)] == turns
    assert [chat.unescaped(t[a:b]) for t, a, b, _ in told] == [text for _, text in turns]


def test_escapes_are_the_least_that_come_back():
    assert [chat.render("user", t)[3] for t in ("plain # \\ text", "### x", "a</turn>", "\\### x", "ends \\", "a\\\\b")] == [0, 1, 1, 2, 2, 2]
    for text in ("### user: a", "### user: a</turn>", "user: a</turn>\n", "### user: ### </turn>\n", "### user: a</turn>\nrest"):
        with pytest.raises(chat.Conflict):
            list(chat.parse(text))


def test_chats_are_read_back(spark, talks, tmp_path):
    rows = talks + [(1, 50, "assistant", "x" * 3_000_000), (1, 51, "assistant", "y" * 3_000_000), (2, 1, "as: sistant", "\\</turn>"), (3, 0, "assistant", queries.HOSTILE)]
    df = frame(spark, rows)
    chats = chat.format_chats(df, most=1 << 20)
    got = {r.conv_id: r for r in chat.read_back(chats, in_order=True).collect()}
    want = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append(((turn is not None, turn or 0, role or "", text or ""), role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [x[1:] for x in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in turns)
    chats.write.parquet(f"{tmp_path}/chats")
    kept = spark.read.parquet(f"{tmp_path}/chats").repartition(3)
    assert kept.where("conv_id = 1 and part > 0").count() > 0 and kept.agg(F.max("escapes")).first()[0] == 2
    assert {r.conv_id: r for r in chat.read_back(kept).collect()} == got
    assert chat.read_turns(kept).count() == len(rows)
    assert chat.read_back(chat.format_chats(df.limit(0)), in_order=True).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_hostile_conversation_is_there(spark):
    (r,) = queries.op13_chat(spark, SF).where("conv_id = -7").collect()
    assert (r.n_turns, r.loss_chars) == (2, len(queries.HOSTILE))
