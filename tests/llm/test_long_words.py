"""Words of any length are summed over all their segmentations."""

import numpy as np

from kinetra.llm import language


def plain(pieces, vocab, table, word):
    """log P by one sum a letter, in logarithms."""
    marked, place = language.SPACE + word, {p: i for i, p in enumerate(vocab)}
    out = np.full((len(marked) + 1, table.shape[1]), -np.inf)
    out[0] = 0
    for end in range(1, len(marked) + 1):
        for n in range(1, min(pieces.longest, end) + 1):
            k = place.get(marked[end - n : end], pieces.size if n == 1 else None)
            if k is not None:
                out[end] = np.logaddexp(out[end], out[end - n] + np.log(table[k]))
    return out[-1]


def test_long_words_are_whole():
    rng = np.random.default_rng(0)
    vocab = sorted({"▁", "a", "b", "ab", "ba", "aba", "bbab", "▁a", "abbabba", "c"})
    pieces, table = language.Pieces(vocab), rng.dirichlet(np.ones(len(vocab) + 1), 3).T
    words = ["".join(rng.choice(list("abcz"), p=[0.5, 0.4, 0.05, 0.05], size=n)) for n in (5, 32, 33, 34, 64, 200, 201, 1500, 5000)]
    want = np.array([plain(pieces, vocab, table, w) for w in words])
    assert np.allclose(language.forward(pieces, table, words), want, rtol=1e-9)
    for block in (7, 64, 10_000):
        assert np.allclose(language.running_sums(pieces, table, words, block), want, rtol=1e-9)
    for w in words[:3]:
        assert np.allclose(language.expected_long(pieces, table[:, 0], w), language.expected(pieces, table[:, 0], [w], np.array([1.0])), rtol=1e-9)
    both = language.expected(pieces, table[:, 0], [words[0], words[5]], np.array([2.0, 3.0]))
    assert np.allclose(both, 2 * language.expected_long(pieces, table[:, 0], words[0]) + 3 * language.expected_long(pieces, table[:, 0], words[5]))


def test_a_word_of_200_letters_is_scored_as_the_recursion_says():
    vocab = ["a", "aa", "b", "▁"]
    model = language.Model(["x", "y"], vocab, np.array([[0.3, 0.1], [0.1, 0.4], [0.3, 0.2], [0.2, 0.2], [0.1, 0.1]]))
    word = "a" * 120 + "b" * 80
    logs = plain(model.pieces, vocab, model.table, word)
    (lang, score), (again, _) = model.score([f"{word} {word}", word])
    total = 2 * logs
    assert lang == again == ["x", "y"][int(np.argmax(total))] and abs(score - 1 / (1 + np.exp(-abs(total[0] - total[1])))) < 1e-9
    assert not model.cache  # long words are not kept


def test_null_ids_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(None, "en", f"word{i} and some more text") for i in range(400)], "doc_id bigint, lang string, text string")
    assert 0 < language.labelled_texts(docs, 40)[0].count() < 120
