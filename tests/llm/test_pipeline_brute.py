"""run() of the corpus pipeline against a plain version of all five stages, on a small table with awkward rows."""

import itertools
import math
import random
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import xxhash

from kinetra.llm import language
from kinetra.llm.decontaminate import question_answer, tokens
from kinetra.llm.queries import MIXING_SQL

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, spans string, size string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(4)
    vocab = {"en": ["the", "river", "stone", "walk", "under", "bright", "with", "house", "seven", "ing"], "de": ["der", "fluss", "stein", "unter", "hell", "mit", "haus", "sieben", "und", "ung"]}
    say = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(("", "s", "er", ".")) for _ in range(n))
    passage, item = say("en", 60), "What is the colour of the seventh house? " + say("en", 9)
    rows = [(i, say("en" if i % 2 else "de", 40 + i), "en" if i % 2 else "de", (None, "a", "b", "")[i % 4], 1, "r", "s", "z") for i in range(60)]
    text = lambda i: rows[i][1]
    more = [text(3), text(3), text(4) + " ", say("en", 30) + " " + passage + " " + say("en", 20), say("de", 90) + " " + passage, say("en", 50) + " " + item + " " + say("en", 50), None, "", " \n", "½ 7", text(5)[:90] + " x"]
    rows += [(100 + k, t, None, "a", None, None, None, None) for k, t in enumerate(more)]
    rows += [(None, say("en", 33), "en", "b", 2, "r", "s", "z"), (7, say("en", 44), "en", "b", 2, "r", "s", "z"), rows[8], rows[8], (None, text(9), "en", "c", 3, "q", "s", "z")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path), [list(r) for r in rows], item


def plain_language(rows, model):
    """Documents with a letter whose best language has half of the posterior: all segmentations summed by recursion."""
    known, longest = {p: i for i, p in enumerate(model.vocab)}, max(map(len, model.vocab))

    def total(word, k):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for n in range(1, min(longest, end) + 1):
                i = known.get(word[end - n : end], len(model.vocab) if n == 1 else None)
                sums[end] += sums[end - n] * model.table[i, k] if i is not None else 0
        return sums[-1]

    out = []
    for r in rows:
        words = "".join(c if c.isalpha() else " " for c in (r[1] or "").lower()).split()
        if words:
            logs = [sum(math.log(total("▁" + w, k)) for w in words) for k in range(len(model.langs))]
            if 1 / sum(math.exp(x - max(logs)) for x in logs) >= 0.5:
                out.append(r)
    return out


def plain_single(rows):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in shingles) > len(shingles))

    fps, group = [fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    groups = [[rows[i] for i in range(len(rows)) if group[i] == g] for g in sorted(set(group))]
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups], groups


def plain_cut(rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[k : k + 240] for t in texts for k in range(len(t) - 239))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - 239):
            if seen[t[k : k + 240]] > 1:
                gone[k : k + 240] = b"\1" * 240
        kept, at = b"", 0
        for hit, run in itertools.groupby(range(len(t)), key=lambda i: gone[i]):
            part = t[at : at + len(list(run))]
            at += len(part)
            if not hit or (len(part) < 400 and len(part.split()) <= 50):
                kept += part
        if kept or not t:
            out.append(r if kept == t else [r[0], kept.decode("utf-8", "ignore"), r[2], r[3], len(kept.decode("utf-8", "ignore")), *r[5:]])
    return out


def plain_clean(rows, item):
    """Rows without a passage of twice the item's words that has half of its trigrams' weight and of both parts' bigrams."""
    words = tokens(item)
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    q, a = question_answer(item)
    out = []
    for r in rows:
        t, hit = tokens(r[1] or ""), False
        for s in range(0, max(1, len(t) - len(words)), len(words)):
            p = t[s : s + 2 * len(words)]
            shares = [len(grams(w, n) & grams(p, n)) / len(grams(w, n)) for w, n in ((words, 3), (q, 2), (a, 2))]  # one item: all its trigrams weigh the same but for their number
            hit |= min(shares) >= 0.5
        if not hit:
            out.append(r)
    return out


def test_run_against_brute_force(spark, folder):
    path, rows, item = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")] + ["source_size", "target", "taken"]
    model = language.train(spark.read.parquet(f"{path}/documents.parquet"))
    told = plain_language(rows, model)
    single, groups = plain_single(told)
    assert len(told) < len(rows) and len(single) < len(told)
    ties = [g for g in groups if len([r for r in g if (r[0] is None, r[0]) == min((x[0] is None, x[0]) for x in g)]) > 1]
    assert all(len({tuple(r) for r in g if r[0] == min(x[0] or 0 for x in g)}) <= 1 for g in ties)  # no draw by row hash in this table
    cut = plain_cut(single)
    assert sum(len(r[1]) for r in cut) < sum(len(r[1]) for r in single) - 400
    clean = plain_clean(cut, item)
    assert len(clean) == len(cut) - 1
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in clean])
    want = Counter((i, n, s, round(t, 6), k) for i, n, s, t, k in db.sql(MIXING_SQL).fetchall() if k > 0)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == want
    texts = Counter((r[0], r[1]) for r in clean)
    assert all(texts[(r.doc_id, r.text)] > 0 for r in got.collect())


def test_run_without_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
