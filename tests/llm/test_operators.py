"""Each operator on small tables with the awkward cases, against brute force where there is one."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetra.llm import components, decontaminate, extract, language, mixing, mixing_lm, quality, rules, simhash, suffix, toxicity
from kinetra.llm.common import labelled_sample, part_by_keys

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, h string, y int, word string, size string, key string, row string"
RND = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ti", "re", "su") for b in ("n", "ra", "lo", "mi", "te", "po")]


def sentence(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


LONG = sentence(120)
TEXTS = [
    None, "", "   \n\t ", "one", "Two Words", "é ü ñ – ça", "!!! ### 123", LONG, LONG, LONG + " tail that differs", "start that differs " + LONG, sentence(30), sentence(30),
    "x " * 600, sentence(3000), "ß" * 700, "word" * 3000, LONG[50:600], "A\nB\nA\nA\n\n", sentence(12) + "\x00 " + sentence(5), "the idiot and the moron " + sentence(20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "é", "")[i % 5], None if i % 2 else 3, i * 2, "h", i, "w", "s", "k", "r") for i, t in enumerate(TEXTS)]
    rows += [(None, LONG, "en", "a", 1, 1, "h", 1, "w", "s", "k", "r"), (3, "one", "en", "a", 1, 1, "h", 1, "w", "s", "k", "r"), (3, "one", "en", "a", 1, 1, "h", 1, "w", "s", "k", "r")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 20)) for i in range(len(TEXTS))] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def pairs(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


def test_simhash_against_brute_force(docs):
    fps = []
    for i, t in pairs(docs):
        w = t.lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        fps.append((i, sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))))
    group = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((fps[k][0] for k in range(len(fps)) if group[k] == g and fps[k][0] is not None), default=None) for g in group}
    want = Counter((i, f"{f:016x}", least[g]) for (i, f), g in zip(fps, group, strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    rnd = random.Random(6)
    a, b, c, d = (sentence(n, rnd) for n in (900, 80, 80, 80))
    near = a + " ."
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(near.encode())).bit_count() <= 3
    rows = [(1, a, "x"), (1, b, "x"), (1, near, "x"), (2, a, "y"), (None, c, "x"), (None, d, "x"), (None, d, "x"), (None, a, "x"), (3, b, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark, df.repartition(3), "").collect()]
    again = [(r.doc_id, r.text) for r in simhash.keep_one(spark, df.repartition(2), "").collect()]
    assert Counter(got) == Counter(again)
    assert [i for i, t in got if t in (a, near)] == [1] and Counter(x for x in got if x[1] not in (a, near)) == Counter([(1, b), (None, c), (None, d)])


def test_every_pair_in_the_radius_shares_a_bucket():
    masks = simhash.covering_masks(list(range(64)), 3)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        change = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(not m & change for m in masks)


def test_large_buckets_split_without_losing_links(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(63, 2, replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(1 << 62, size=50)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = [dict(map(tuple, components.components(simhash.links(df, 3, most)).collect())) for most in (4096, 4)]
    classes = [sorted(Counter(r.get(f, f) for f in fps).values()) for r in roots]
    assert classes[0] == classes[1] and max(classes[0]) >= 140


def test_filter_ahead_of_a_shuffle_misses_no_key(spark):
    df = spark.range(3000).selectExpr("id", "xxhash64(id) as k")
    keys = df.where("id % 7 = 0")
    may, never = part_by_keys(df, F.col("k"), keys, F.col("k"))
    got = {r.id for r in may.collect()}
    assert got >= set(range(0, 3000, 7)) and len(got) < 450 and got.isdisjoint({r.id for r in never.collect()}) and may.count() + never.count() == 3000
    assert part_by_keys(df, F.col("k"), keys.limit(0), F.col("k"))[0].count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    assert dict(map(tuple, components.components(edges).collect())) == {**{i: 0 for i in range(1, 61)}, 101: 100}


def brute_suffix(rows, length):
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_passages(rows, length, words=50, most=400):
    """Bytes of runs covered by repeated strings of `length` bytes that have more than `words` words, or `most` bytes."""
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in rows:
        n = end = start = 0
        for k in [*(k for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1), len(t) + 1]:
            if k > end:
                n += end - start if end - start >= most or len(t[start:end].split()) > words else 0
                start = k
            end = k + length
        out[(i, len(t), n)] += 1
    return out


def test_suffix_dedup_against_brute_force(docs):
    got = suffix.suffix_dedup(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_suffix(pairs(docs), 400)
    assert Counter((r.doc_id, r.n_bytes, r.n_passage_bytes) for r in got) == brute_passages(pairs(docs), 240)


def test_suffix_dedup_of_near_copies(spark):
    rnd = random.Random(3)
    base = [sentence(400, rnd) for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = "#"
        rows.append((i, "".join(t)[rnd.randint(0, 300) :]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_suffix([(i, t.encode()) for i, t in rows], 400)
    short = brute_passages([(i, t.encode()) for i, t in rows], 240)
    got = suffix.suffix_dedup(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == want and Counter((r.doc_id, r.n_bytes, r.n_passage_bytes) for r in got) == short
    own = suffix.keyed(df)
    for length, reach in ((400, None), (240, 400)):
        spans = suffix.repeated(own.select("id", "h", "text"), length, reach, most=3)  # hot anchors go by cores
        got = {r.id: sum(e - s for s, e in suffix.merged_spans(r.spans, far=bool(reach))) for r in spans.collect()}
        assert {k: v for k, v in got.items() if v} == {w[0]: w[2] for w in want if w[2]}


@pytest.mark.parametrize("size", [400, 404, 470])
def test_a_passage_of_many_documents_fills_no_group(spark, size):
    rnd = random.Random(size)
    passage = sentence(200, rnd)[:size]
    rows = [(i, sentence(60, rnd) + f" {i} " + passage + f" {i * 7} " + sentence(60, rnd)) for i in range(80)]
    df = suffix.keyed(spark.createDataFrame(rows, "doc_id bigint, text string")).select("id", "h", "text").cache()
    want = brute_suffix([(i, t.encode()) for i, t in rows], 400)
    for length, reach in ((400, None), (240, 400)):
        got = {r.id: sum(e - s for s, e in suffix.merged_spans(r.spans, far=bool(reach))) for r in suffix.repeated(df, length, reach, most=8).collect()}
        assert {k: v for k, v in got.items() if v} == {w[0]: w[2] for w in want if w[2]}
    kept = suffix.contexts(df, 400)
    folded = kept.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "a", "n", "off", "m")).alias("one"))
    many = folded.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    asked = folded.join(many, "anchor").select("anchor", "ctx", "c", "one.*", (F.col("m") > 8).alias("hot"))
    assert asked.where("hot").count() >= 80
    strings = suffix.merged_strings(df, asked, 400, 400, 8)[0]
    assert (strings.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0) <= 8


def test_merged_transforms_are_the_sorted_suffixes():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(12)]
    windows = np.array([len(s) - 20 + 1 for s in strings])
    strings += [s[:55] for s in strings[:3]]
    windows = np.append(windows, [36] * 3)
    runs = suffix.repeated_windows(strings, windows, np.ones(15, int), (20, 30), 10, shards=3)
    for length, got in zip((20, 30), runs, strict=True):
        seen = Counter(s[k : k + length] for s in strings for k in range(len(s) - length + 1))
        want = [(i, k) for i, (s, n) in enumerate(zip(strings, windows.tolist(), strict=True)) for k in range(n) if len(s) - k >= length and seen[s[k : k + length]] > 1]
        assert [(i, k) for i, lo, hi in zip(*(x.tolist() for x in got), strict=True) for k in range(lo, hi)] == want
    with pytest.raises(ValueError):
        suffix.repeated_windows(strings, windows, np.ones(15, int), (25,), 10)
    with pytest.raises(ValueError):
        suffix.block_of(240, 401)


def test_a_text_in_pieces_loses_the_same_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rnd = random.Random(12)
    passage = sentence(90, rnd)
    rows = [(i, sentence(400, rnd) + " " + passage + " " + sentence(300, rnd) + " " + passage[: 200 + 30 * i]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert Counter(tuple(r)[:5] for r in suffix.suffix_dedup(df).collect()) == brute_suffix([(i, t.encode()) for i, t in rows], 400)


def test_symbols_of_large_parts_order_alike():
    ranks = np.random.default_rng(9).integers(0, 1 << 20, 100_000).astype(np.uint32)
    assert (suffix.stable_order(ranks) == np.argsort(ranks, kind="stable")).all()


def test_suffix_stage_cuts_text(spark, docs):
    out = suffix.suffix_stage(spark, docs, "")
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[11] == TEXTS[11] and 7 not in texts and 0 in texts and LONG not in (texts[9] or "")


def test_decontamination(spark, docs, none):
    items = [(0, TEXTS[11]), (1, "What is the name of the river? " + sentence(8)), (2, None), (3, ""), (4, "single")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    extra = spark.createDataFrame([(50, sentence(200) + " " + items[1][1] + " " + sentence(200)), (51, sentence(500))], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect()}
    assert got == {(11, 0), (50, 1)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(rows, bench.limit(0)).count() == 0


def test_block_max_search_finds_all():
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(8)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 15)))) for i in range(200)]
    terms = [decontaminate.terms(decontaminate.tokens(t)) for _, t in items]
    df = Counter(t for x in terms for t in set(x))
    index = decontaminate.Index.build(items, df, len(items), float(np.mean([len(x) for x in terms])), 2)
    index.block = 4
    index.tops = [np.maximum.reduceat(x, np.arange(0, len(x), 4)) for x in index.impacts]
    for threshold in (0.1, 0.3, 0.6):
        query = sorted(rnd.sample(range(1, len(index.postings) + 1), 60))
        scores = Counter()
        for t in query:
            for i, x in zip(index.postings[t - 1].tolist(), index.impacts[t - 1].tolist(), strict=True):
                scores[i] += x
        assert {i for i, _ in index.search(query, threshold)} == {i for i, x in scores.items() if x >= threshold - 1e-12}


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs, block=4, shards=4).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for i, t in pairs(docs):
        sizes[i] += len(t.split())
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.size
        assert 0 <= r.taken <= 2 * r.size
    assert got == sizes
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    total = sum(sizes.values())
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert all(abs(sum(v) - t) <= 12 for (s, t), v in by.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2), block=4, shards=4).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_sainte_lague_seats(spark):
    claims = [5300, 2400, 1100, 900, 290, 8, 1, 0]
    df = spark.createDataFrame([(0, i, float(c), 60, len(claims), 10_000, str(i)) for i, c in enumerate(claims)], "g int, i int, claim double, seats bigint, parties bigint, most bigint, rank_key string")
    got = {r.i: r.quota for r in mixing._quotas(df, ["g"], "claim").collect()}
    won = Counter()
    for _ in range(60):
        won[max(range(len(claims)), key=lambda i: claims[i] / (2 * won[i] + 1))] += 1
    assert got == {i: won[i] for i in range(len(claims))}


def test_language(docs, none):
    got = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i in (0, 1, 2, 6):
        assert got[(i, zlib.crc32(str(i).encode()) % 3 == 1)] == ("und", 0.0)
    assert all(lang in ("en", "fr", "und") and 0 <= s <= 1 for lang, s in got.values())
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_and_ties_of_languages():
    assert language.words("½ ² Ⅷ ① 7 _ - x² Éa") == ["x", "éa"]
    model = language.Model(["de", "en"], ["a", "▁"], np.full((3, 2), 1 / 3))
    assert model.score(["½ ²", "", "a aa"]) == [("und", 0.0), ("und", 0.0), ("de", 0.5)]


def test_forward_sums_all_segmentations():
    vocab = sorted({"▁", "a", "b", "ab", "▁a", "ba", "aba"})
    pieces, rng = language.Pieces(vocab), np.random.default_rng(0)
    table = rng.random((len(vocab) + 1, 2)) / 10

    def total(word, k):
        if not word:
            return 1.0
        known = sum(table[vocab.index(word[:n]), k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in vocab)
        return known + (0 if word[0] in vocab else table[-1, k] * total(word[1:], k))

    batch = ["aba", "b", "abab", "cab", "aaaaab"]
    want = [[total("▁" + w, k) for k in range(2)] for w in batch]
    assert np.allclose(np.exp(language.forward(pieces, table, batch)), want)
    uses = language.expected(pieces, table[:, 0], ["aba"], np.array([1.0]))
    mass = sum(len(p) * uses[i] for i, p in enumerate(vocab)) + uses[-1]
    assert abs(mass - 4) < 1e-9  # the expected pieces cover the word and its start mark


def test_quality_and_toxicity(docs, none, labels, no_labels):
    for run, n, fold in ((quality.classify, 3, 1), (toxicity.detect, 5, 0)):
        rows = run(docs, labels).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == fold) for r in rows if r.doc_id is not None)
        assert run(none, labels).count() == 0
        assert run(docs, no_labels).count() == docs.count()


def test_two_classes_are_told_apart(spark):
    rnd = random.Random(8)
    rows = [(i, (sentence(40, rnd) if i % 2 else " ".join(w + "***" for w in sentence(40, rnd).split())) + (" vile" if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in quality.classify(docs, labels).where("held_out").collect())
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.detect(docs, labels).where("held_out").collect())


def test_sampled_rows_weigh_what_they_stand_for(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'x' text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 > 0 as int) quality")
    got = {r.y: (r.n, r.w) for r in labelled_sample(docs, labels, "quality", F.lit(True), 500).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert got[0] == (400, 400) and got[1][0] < 700 and abs(got[1][1] - 3600) < 500


def test_probabilities_follow_the_base_rate():
    rng = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 1000)
    x, weight = rng.normal(0, 1, (2000, 2)) + y[:, None], np.where(y == 1, 9.0, 1.0)
    p = quality.Network(2).fit(x, y, weight=weight).probability(x)
    assert abs(np.average(p, weights=weight) - 0.9) < 0.03
    rows = [np.array([0] * int(a)) for a in rng.integers(0, 3, 2000) + (1 - y) * 2]
    model = toxicity.Linear(1)
    model.w[0] = 1.0
    model.calibrate(rows, 1 - y, weight=weight)
    assert abs(np.average(model.probability(rows), weights=weight) - 0.1) < 0.03


def test_risk_and_its_gradient_against_a_plain_version():
    rng = np.random.default_rng(3)
    loss = lambda z, y: float(np.log1p(np.exp(-y * z)))
    for shift, prior in ((0.0, 0.2), (-4.0, 0.6)):
        p, u = rng.normal(1, 1, 7), rng.normal(shift, 0.5, 11)
        plus, rest, d_p, d_u = toxicity.risk(p, u, prior)
        plain_plus = prior * sum(loss(z, 1) for z in p) / 7
        plain_rest = lambda p, u, prior=prior: sum(loss(z, -1) for z in u) / 11 - prior * sum(loss(z, -1) for z in p) / 7
        assert abs(plus - plain_plus) < 1e-12 and abs(rest - plain_rest(p, u)) < 1e-12 and (rest >= 0) == (shift == 0.0)
        step = lambda p, u, prior=prior, rest=rest, plain_rest=plain_rest: prior * sum(loss(z, 1) for z in p) / 7 + plain_rest(p, u) if rest >= 0 else -plain_rest(p, u)
        for x, d in ((p, d_p), (u, d_u)):
            for i in range(len(x)):
                x[i] += 1e-6
                up = step(p, u)
                x[i] -= 2e-6
                assert abs((up - step(p, u)) / 2e-6 - d[i]) < 1e-6
                x[i] += 1e-6


def test_unlabelled_texts_teach_without_their_labels(spark):
    """Labels cover one in eight; a clean kind of text that no label covers is still left alone."""
    rnd = random.Random(18)
    kind = lambda i: " vile" if i % 10 == 0 else " odd" if i % 10 in (1, 2, 3) else ""
    docs = spark.createDataFrame([(i, sentence(30, rnd) + kind(i)) for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1500) if i % 10 in (0, 5)], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == int(r.doc_id % 10 == 0) for r in toxicity.detect(docs, labels).collect())


def test_pooled_vectors_and_network_against_a_plain_version():
    rng = np.random.default_rng(5)
    vocabulary = quality.Vocabulary(["aa", "bb", "!!"])
    vectors = rng.normal(size=(len(vocabulary.tokens), quality.DIM)).astype(np.float32)
    ids = [vocabulary.ids[t] for t in ("aa", "bb", "<title>", "!!", "<number>", "aa")]
    v = vectors[ids].astype(float)
    mean = v.mean(axis=0)
    want = [*mean, float(np.sqrt((mean**2).sum())), sum(float(v[i] @ v[i + 1]) for i in range(5)) / 6, sum(float(v[i] @ v[i + 2]) for i in range(4)) / 6, np.log1p(6) / 10]
    got = quality.pooled(vocabulary, vectors, ["aa bb Cc !! 77 aa", ""])
    assert np.allclose(got[0], want, atol=1e-5) and not got[1].any()
    net = quality.Network(3, hidden=4)
    x = rng.normal(size=(5, 3))
    plain = [sum(np.tanh(sum(x[r, i] * net.w1[i, j] for i in range(3)) + net.b1[j]) * net.w2[j] for j in range(4)) + net.b2[0] for r in range(5)]
    assert np.allclose(net.logits(x), plain)
    y = (rng.random(3000) < 0.5).astype(float)
    z = rng.normal(size=(3000, 3)) + y[:, None]
    fitted = quality.Network(3, hidden=4).fit(z, y)
    exact = 1 / (1 + np.exp(-(z.sum(axis=1) - 1.5)))  # the true probability of these rows
    assert np.abs(fitted.probability(z) - exact).mean() < 0.06


def test_rules(docs, none, labels, no_labels):
    got = {(r.doc_id, r.n_words): r for r in rules.filter_rules(docs, labels).collect()}
    for i, b in pairs(docs):
        t, w = b.decode(), [x.decode() for x in b.split()]
        lines = [x for x in t.split("\n") if x.encode().strip()]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert rules.filter_rules(none, labels).count() == 0
    assert rules.filter_rules(docs, no_labels).where("not base_failed and not kept").count() == 0


def test_isolation_forest_finds_what_is_far():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(400, 3))
    forest = rules.Forest(np.concatenate((rows, rng.normal(8, 1, (8, 3)))))
    assert forest.score(np.full((1, 3), 8.0))[0] > np.quantile(forest.score(rows), 0.99)


def test_every_row_weighs_in_the_forest_and_its_threshold(spark):
    """Leaves hold all rows, not those of the trees; the cut is the best over all labelled rows."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(5000, 3))
    forest = rules.Forest(rows, 7, 16, dealt=True)
    before = forest.score(rows[:50])
    forest.weigh(sum(forest.counts(x) for x in np.array_split(rows, 3)))
    paths = [forest.trees[k][4][at] for k, at in enumerate(forest.leaves(rows))]
    assert (forest.counts(rows).sum(axis=1) == 5000).all() and not np.allclose(forest.score(rows[:50]), before)
    assert np.corrcoef(np.mean(paths, axis=0), np.abs(rows).max(axis=1))[0, 1] < -0.3
    score, good = np.round(rng.random(8000), 2), rng.random(8000) < 0.9
    score[good] *= 0.9
    cuts = [(-((score[good] <= c).mean() + (score[~good] > c).mean()), c) for c in np.unique(score) if (score[good] <= c).mean() >= 0.99]
    df = spark.createDataFrame(list(zip(score.tolist(), good.astype(int).tolist(), strict=True)), "anomaly double, y int").repartition(3)
    assert rules.threshold(df) == min(cuts)[1] and rules.threshold(df.limit(0)) == 1.0


def test_language_model(docs, none):
    rows = mixing_lm.lm_score(docs).collect()
    train = Counter()
    for i, t in pairs(docs):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*t.lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in pairs(docs):
        w = [*t.lower().split(), b"\n"]
        want[(i, len(w), sum(train[x] > 0 for x in w), n, round(float(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w)), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert mixing_lm.lm_score(none).count() == 0


def test_tables_and_dealt_streams_take_every_use(spark):
    rnd = random.Random(2)
    words = sorted({w.encode() for w in WORDS} | {f"rare{i}".encode() for i in range(400)})
    rows = [(w, 1 + rnd.randrange(40), rnd.randrange(9)) for w in words]
    counts = spark.createDataFrame(rows, "word binary, n bigint, m bigint").selectExpr("word", "n + m as n", "m").repartition(3)
    zeros, ones = (np.zeros(int(mixing_lm.OFFSETS[-1]), np.int64) for _ in range(2))
    for w, n, _ in rows:  # one word at a time, each use counted
        for _, slots, bit in mixing_lm.Stream([w]).bits():
            for k in range(len(mixing_lm.TABLES)):
                for at, b in zip(slots[k].tolist(), bit.tolist(), strict=True):
                    (ones if b else zeros)[at] += n
    logit, seen = mixing_lm.tables(counts)
    assert (seen == np.digitize(zeros + ones, mixing_lm.LEVELS)).all()
    assert (logit == np.log((ones + 0.1) / (zeros + 0.1)).astype(np.float16)).all()
    shared = spark.sparkContext.broadcast((logit, seen))
    one, many = (mixing_lm.learned(mixing_lm.Model(logit, seen), shared, counts, n) for n in (10**9, 500))
    again = mixing_lm.learned(mixing_lm.Model(logit, seen), shared, counts.repartition(2), 500)
    assert (many.by_place == again.by_place).all() and (many.refined == again.refined).all()
    stream = [w for w, _, m in rows for _ in range(m)]
    plain = mixing_lm.Model(logit, seen)
    assert one.score(stream).sum() > plain.score(stream).sum() and many.score(stream).sum() > plain.score(stream).sum()


def test_every_training_text_teaches_the_weights(spark):
    """Also where no text of a small table would fall into a sample; each use is foreseen by tables without its own bits."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(40))) for i in range(30)]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*t.lower().encode().split(), b"\n"])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = mixing_lm.word_counts(docs)
    assert {bytes(r.word): r.n for r in counts.where("n > 0").collect()} == train
    table = np.zeros((int(mixing_lm.OFFSETS[-1]), 2), np.int64)
    mixing_lm.tally(sorted(train), np.array([train[w] for w in sorted(train)]), table)
    logit, seen, without, less = mixing_lm.tables(counts.selectExpr("word", "n", "0 as m"), left_out=True)
    for bit in (0, 1):
        at = np.flatnonzero(table[:, bit])
        zeros, ones = (table[at] - np.eye(2, dtype=int)[bit]).T
        assert (without[bit, at] == np.log((ones + 0.1) / (zeros + 0.1)).astype(np.float16)).all() and (less[at] == np.digitize(zeros + ones, mixing_lm.LEVELS)).all()
    plain = mixing_lm.Model(logit, seen)
    got = {r.doc_id: r.score for r in mixing_lm.lm_score(docs).where("held_out").collect()}
    unlearned = {i: plain.score([*t.lower().encode().split(), b"\n"]).sum() for i, t in rows if i in got}
    assert got and all(got[i] > unlearned[i] + 1 for i in got)


def test_scores_do_not_depend_on_how_words_travel(docs):
    a, b = ({(r.doc_id, r.n_tokens): round(r.score, 6) for r in mixing_lm.lm_score(docs, most).collect()} for most in (300_000, 3))
    assert a == b


def test_language_model_without_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = mixing_lm.lm_score(spark.createDataFrame([(i, "some words") for i in held], "doc_id bigint, text string")).collect()
    assert len(rows) == 4 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in rows)


def test_language_model_is_a_distribution():
    """The probabilities of all bytes after a prefix sum to one: each bit's two outcomes share it."""
    rng = np.random.default_rng(6)
    size = int(mixing_lm.OFFSETS[-1])
    model = mixing_lm.Model(rng.normal(size=size).astype(np.float16), rng.integers(0, mixing_lm.KNOWN, size).astype(np.uint8))
    every = [bytes([b]) for b in range(256) if b not in (10, 32)]
    ends = 10 ** model.score([mixing_lm.END])[0]
    # score() adds the space after the byte: divide by its probability, got from the longest common part of two words.
    stream = mixing_lm.Stream([*every, mixing_lm.END, b""])
    total = np.zeros(len(stream.data))
    for node, slots, bit in stream.bits():
        _, _, z, _, _, fine = model._mix(node, slots, stream.place)
        p = 0.5 * fine + 0.5 / (1 + np.exp(-z))
        total += np.log(np.where(bit == 1, p, 1 - p))
    assert abs(np.exp(total[stream.starts]).sum() - 1) < 1e-6 and 0 < ends < 1


def test_extraction(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  para\ngraph with <b>bold</b> text.<p>Second one that goes on for a while, as articles do.</article>"
    page = lambda i: f"<html><head><title>t{i}</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy now {i}</div>{article}<footer>&copy; {i}</footer></body></html>"
    rows = [(i, f"u{i}", page(i)) for i in range(30)] + [(90, None, None), (91, "u", ""), (None, "u", page(3)), (92, "u", "<p>broken <div><a href="), (93, "u", page(3).replace("article>", "main>"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages).collect()}
    want = "Title & more\nFirst para graph with bold text.\nSecond one that goes on for a while, as articles do."
    assert got[4] == got[None] == got[93] == (want, len(want))
    assert got[90] == got[91] == ("", 0)
    assert extract.extract(pages.limit(0)).count() == 0


HOSTILE = ['<a "', "<p x", "<a '\"", "<div>x", "<b>x", "</section>", "<div></section>", "<b><h1>", "<li>y", '<p class="a b">z', "<!", "<svg/>", "<", "&#x;", '<a "x" ', "<table><tr><td>q"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_broken_markup_takes_time_in_proportion_to_the_page(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    found = extract.blocks(page + '">', {"t=div": 1.0})
    assert time.process_time() - began < 20 and all(b.text for b in found)  # a few seconds at most; quadratic time takes hours


def test_blocks_of_a_small_page():
    page = "<div class='a'><p>one<p>two <b>bold<div>in</b></div></p>x<ul><li>i<li>j</ul><td>c<td>d<!-- no --><script>if (a<b) '</p>'</script>e<a href=\"a>b\">l</a> &lt;&amp;"
    found = extract.blocks(page)
    assert [b.text for b in found] == ["one", "two bold", "in", "x", "i", "j", "c", "d", "el <&"]
    assert all("c=a" in b.path.names for b in found) and found[0].path.inner == "p" and found[1].path.inner == "p" and found[4].path[1:] == ("li", "ul")
    assert [b.text for b in extract.blocks("a<b class='x y>never ends")] == ["a"]


def test_extraction_of_awkward_rows(spark):
    body = "<article><p>" + "A sentence of the article that is long enough, as they are. " * 3 + "</p></article>"
    rows = [(i % 5, f"u{i % 5}", f"<body><nav><a href='/'>Home</a></nav>{body}<footer>f</footer>" if i != 7 else "<body><article>" + "<p>word</p>" * 100_000 + "</article>", "x", i) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = extract.extract(pages).collect()
    assert len(got) == 20 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert max(r.n_chars for r in got) == 100_000 * 5 - 1 and all(r.n_chars == len(r.text) for r in got)


def test_viterbi_is_the_best_labelling():
    field, rng = extract.Field(), np.random.default_rng(7)
    field.start, field.moves = rng.normal(size=2), rng.normal(size=(2, 2))
    blocks = [extract.Block("text", extract.Path(frozenset([f"t=t{i}"]), "", ""), 0, 0) for i in range(7)]
    field.weights = {f"t=t{i}": float(rng.normal()) for i in range(7)}
    e = [field.emission(b) for b in blocks]
    score = lambda s: field.start[s[0]] + sum(e[i] * s[i] for i in range(7)) + sum(field.moves[s[i], s[i + 1]] for i in range(6))
    best = max((tuple(k >> i & 1 for i in range(7)) for k in range(128)), key=score)
    assert tuple(field.decode(blocks)) == best


def test_lm_tree_shares_first_bytes():
    """Sums over shared bytes equal those byte by byte: long, nested and repeated words, zero bytes, in any order."""
    rng = np.random.default_rng(3)
    words = [b"".join(rng.choice([b"a", b"b", b"\0", b"long" * 20], size=rng.integers(0, 6)).tolist()) for _ in range(300)] + [mixing_lm.END]
    counts = rng.integers(1, 9, len(words))
    table, plain = (np.zeros((int(mixing_lm.OFFSETS[-1]), 2), np.int64) for _ in range(2))
    mixing_lm.tally(words, counts, table, 700)
    for w, c in zip(words, counts, strict=True):
        for _, slots, bit in mixing_lm.Stream([w]).bits():
            for row in slots:
                np.add.at(plain, (row, bit), c)
    assert (table == plain).all()
    model = mixing_lm.Model(rng.normal(size=len(table)).astype(np.float16), rng.integers(0, mixing_lm.KNOWN, len(table)).astype(np.uint8))
    np.testing.assert_allclose(model.score(words, 700), [model.score([w])[0] for w in words])


def test_passages_of_51_words_are_cut_and_their_surroundings_kept(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    planted = {i: some(51 + i) for i in range(4)}
    rows = [(d, (before := some(40)) + " " + planted[d % 4] + " " + (after := some(40)), before, after) for d in range(24)] + [(d, some(120), None, None) for d in range(24, 40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in suffix.suffix_stage(spark, docs, "").collect()}
    for d, text, before, after in rows:
        if before is None:
            assert got[d] == text
        else:
            # A letter or two on either side may agree by chance in another document and go with the passage.
            assert planted[d % 4][8:-8] not in got[d]
            assert got[d].startswith(before[:-2]) and got[d].endswith(after[2:])
    told = {r.doc_id: r.n_passage_bytes for r in suffix.suffix_dedup(docs).collect()}
    assert all((told[d] > 0) == (d < 24) for d in told)


def test_extraction_learns_from_marked_pages_wherever_they_are(spark):
    rows = [(i, "u", f"<div><p>menu {i}</p></div>") for i in range(400)] + [(500 + i % 3, "u", f"<nav>menu</nav><article><p>{sentence(40, random.Random(i % 3))}</p></article>") for i in range(60)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    assert sorted(r.text for r in extract.training_pages(df, 200).collect()) == sorted({h for _, _, h in rows if h and "article" in h})
    assert {r.text for r in extract.extract(df).where("page_id >= 500 and page_id < 900").collect()} == {sentence(40, random.Random(i)) for i in range(3)}
