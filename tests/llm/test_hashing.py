import numpy as np

from gaugeworks.llm import hashing as h


def test_char_grams_equal_one_by_one():
    texts = ["abc", "", "äb c", "abc"]
    row, index = h.char_grams(texts, (2, 3))
    for i, t in enumerate(texts):
        r, x = h.char_grams([t], (2, 3))
        assert sorted(index[row == i].tolist()) == sorted(x.tolist())


def test_word_grams_stay_inside_rows():
    row, index = h.word_grams([["a", "b"], ["c"], [], ["a", "b"]], (2,))
    assert row.tolist() == [0, 3] and index[0] == index[1]


def test_fit_separates_and_is_deterministic():
    texts = [f"good word {i}" for i in range(40)] + [f"bad thing {i}" for i in range(40)]
    y = np.array([1] * 40 + [0] * 40)
    x = h.assemble(80, [h.char_grams(texts, (3,))], np.zeros((80, 1)))
    a, b = h.fit(x, y), h.fit(x, y)
    assert (a.weight == b.weight).all() and ((a.probability(x) > 0.5) == y).all()
    z = h.assemble(0, [h.char_grams([], (3,))], np.zeros((0, 1)))
    assert len(a.probability(z)) == 0


def test_threshold():
    p, y = np.array([0.1, 0.3, 0.6, 0.9]), np.array([0, 0, 1, 1])
    assert 0.3 < h.best_threshold(p, y) <= 0.6
