"""op5's words foreseen from the words before them."""

import random
import zlib

import numpy as np

from kinetra.llm import mixing_lm, word_order


def small(words=300, seed=5):
    rng = np.random.default_rng(seed)
    names = [b"w%d" % i for i in range(words)]
    return rng, names, word_order.Code(names, sorted(rng.integers(2, 500, words).tolist(), reverse=True), 77)


def test_the_order_of_words_changes_the_score(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    follow = {w: rnd.sample(words, 2) for w in words}

    def text(n):
        out = [rnd.choice(words)]
        while len(out) < n:
            out.append(rnd.choice(follow[out[-1]]))
        return out

    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    train = [i for i in range(700) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [text(60) for _ in held[:20]]
    rows = [(i, " ".join(text(60))) for i in train] + [(i, " ".join(t)) for i, t in zip(held, texts, strict=False)] + [(i, " ".join(rnd.sample(t, 60))) for i, t in zip(held[20:], texts, strict=True)]
    got = {r.doc_id: r for r in mixing_lm.lm_score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).where("held_out").collect()}
    for a, b in zip(held[:20], held[20:], strict=True):
        assert abs(got[a].base_score - got[b].base_score) < 1e-9 and got[a].score > got[b].score + 20
    assert np.mean([-got[i].score / np.log10(2) / 61 for i in held[:20]]) < 2.5  # a word has two followers: the order tells more than five bits a word


def test_leaves_after_any_words_are_a_distribution():
    rng, names, code = small()
    mixer = word_order.Mixer(code, rng.integers(0, 1 << 16, 2 << word_order.BITS).astype(np.uint16))
    mixer.weights = rng.normal(size=mixer.weights.shape).astype(np.float32) / 4
    assert len(code.size) == 301 and abs((0.5**code.size).sum() - 1) < 1e-12
    _, one, two = code.tokens([[names[3], b"unknown", names[5]]])
    for h, g in zip(one, two, strict=True):
        leaves = np.arange(301)
        assert abs((10 ** mixer.score(leaves, np.full(301, h), np.full(301, g))).sum() - 1) < 1e-4


def test_contexts_are_the_two_words_before_of_the_same_text():
    _, names, code = small()
    a, b, c, d = names[0], b"not known", names[2], names[7]
    leaf, one, two = code.tokens([[a, b, c, d], [d], [], [b, c, d], [a]])
    assert leaf.tolist() == [0, 300, 2, 7, 7, 300, 2, 7, 0]
    assert one[0] == one[4] == one[5] == one[8] and two[0] == two[4] == two[5] == two[8]  # nothing before
    assert one[2] == one[6] and two[2] != two[6] and one[3] == one[7] and two[3] == two[7]
    assert len({int(x) for x in one}) == 4 and all(len(x) == 0 for x in code.tokens([]))


def test_every_decision_is_counted_once():
    """Under both contexts; in any chunks; whole when packed and added up. No two decisions of a token share a slot."""
    rng, names, code = small(60)
    texts = [[names[i] for i in rng.integers(0, 60, 50)] + [b"rare%d" % k] for k in range(30)]
    want = np.zeros((2 << word_order.BITS, 2), np.int32)
    for size, _, bit, *slots in (code.decisions(*(x[i : i + 1] for x in code.tokens(texts))) for i in range(30 * 51)):
        assert size[0] == len(bit) == len(set(slots[0].tolist())) == len(set(slots[1].tolist()))
        for s in slots:
            np.add.at(want, (s, bit.astype(int)), 1)
    for chunk in (7, 4096):
        counts = np.zeros_like(want)
        seen = word_order.Mixer(code).learn(texts, counts, np.full((word_order.KNOWN**2, word_order.INPUTS), 1e-4), chunk)
        assert (counts == want).all() and 2 * seen == want.sum()
    block = want[: word_order.BLOCK] * 1000 + 3
    assert (word_order.unpacked(word_order.packed(block)) == block).all()
