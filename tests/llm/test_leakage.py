import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import leakage as k

DOCS = "doc_id long, text string, item_id string, passage string"
ITEMS = "item_id long, passage string, doc_id string"
VOCAB = [f"w{i}x" for i in range(400)]


def brute(doc, passage):
    """Every alignment, every stretch."""
    a, b = k.words(passage), k.words(doc)
    least = min(18, len(a))
    for s in range(-len(a) + 1, len(b)):
        lo, hi = max(0, -s), min(len(a), len(b) - s)
        same = [a[i] == b[i + s] for i in range(lo, hi)]
        for x in range(len(same)):
            for y in range(x + least, len(same) + 1):
                bad = sum(not e for e in same[x:y])
                if bad * 8 <= y - x and len(a):
                    return True
    return False


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "mine", "mine") for i, t in enumerate(docs)], DOCS)
    e = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(items)], ITEMS)
    return sorted(tuple(r) for r in k.leaked(d, e).collect())


def passage(rng, n=40):
    return rng.choices(VOCAB, k=n)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    items = [passage(rng, n) for n in (40, 60, 18, 25, 10, 4)]
    docs = []
    for _ in range(60):
        own = rng.choice(items)
        a = rng.randrange(max(1, len(own) - 10))
        part = own[a : a + rng.randint(8, 60)]
        part = [rng.choice(VOCAB) if rng.random() < rng.choice([0, 0.1, 0.2]) else w for w in part]
        docs.append(" ".join(passage(rng, rng.randrange(20)) + part + passage(rng, rng.randrange(20))))
    want = sorted((i, j) for i, d in enumerate(docs) for j, p in enumerate(items) if brute(d, " ".join(p)))
    got = found(spark, docs, [" ".join(p) for p in items])
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 60))
def test_stretch_equals_brute_force(same, whole):
    least = min(18, whole)
    want = any(sum(not e for e in same[a:b]) * 8 <= b - a for a in range(len(same)) for b in range(a + least, len(same) + 1))
    assert k.has_stretch(np.array(same, bool), whole) == want


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 2**32 - 1), st.lists(st.integers(0, 63), max_size=18))
def test_blocks_find_all_within_the_radius(seed, flips):
    """The multi-index gives exactly the pairs that comparing every pair of fingerprints gives."""
    rng = np.random.default_rng(seed)
    index = k.Index([(i, rng.integers(0, 2**63, 30).astype(np.uint64)) for i in range(3)], k.WINDOW, k.STRIDE)
    probe = index.prints[[5, 5]].copy()
    for f in flips:
        probe[0] ^= np.uint64(1 << f)
    got = set(zip(*(x.tolist() for x in index.candidates(probe))))
    assert got == {(j, i) for j, q in enumerate(probe) for i, p in enumerate(index.prints) if int(p ^ q).bit_count() <= k.RADIUS}


def test_sums_equal_one_by_one():
    h = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    bits = np.array([[1 if int(x) >> b & 1 else -1 for b in range(64)] for x in h])
    for size in (1, 3, 7, 16, 17):
        for stride in (1, 3):
            want = [bits[a : a + size].sum(axis=0)[[8 * (i // 8) + 7 - i % 8 for i in range(64)]] for a in range(0, 50 - size + 1, stride)]
            assert (k._sums(h, size, stride) == want).all()


def test_recall_on_the_hardest_stretches():
    """Stretches of exactly 18 words with two replaced, and longer ones with one in eight replaced, in other text."""
    rng = random.Random(8)
    items = [(i, " ".join(passage(rng, 50))) for i in range(60)]
    passages, indexes = k.build(items)
    for least, low, high in ((0.95, 18, 18), (0.99, 24, 45)):
        hit = 0
        for _ in range(400):
            i, text = rng.choice(items)
            n = rng.randint(low, high)
            a = rng.randrange(50 - n + 1)
            part = text.split()[a : a + n]
            for j in rng.sample(range(n), n // 8):
                part[j] = f"other{rng.randrange(999)}"
            doc = passage(rng, rng.randrange(30)) + part + passage(rng, rng.randrange(30))
            hit += i in k.search(k.word_hashes(doc, k._Hashes()), passages, indexes)
        assert hit >= least * 400, (low, hit)


def test_spelling_and_markup(spark):
    rng = random.Random(5)
    p = passage(rng, 30)
    text = " ".join(p)
    forms = [text.upper(), "> " + "\n> ".join(" ".join(p[i : i + 5]) for i in range(0, 30, 5)), " ".join(f"**{w}**" if i % 3 else f"<b>{w}</b>" for i, w in enumerate(p)), ", ".join(p), "&quot;" + text + "&quot;", "â€œ" + text + "â€", text.replace(" ", "  \u200b")]
    assert found(spark, forms, [text]) == [(i, 0) for i in range(len(forms))]


def test_nulls_repeats_short_and_long(spark):
    rng = random.Random(6)
    p = " ".join(passage(rng, 30))
    long = " ".join(passage(rng, 250_000)) + " " + p
    assert found(spark, [None, "", p, p, long, " ".join(p.split()[:17])], [p, None, ""]) == [(2, 0), (3, 0), (4, 0)]
    assert found(spark, [p], ["", None]) == [] and found(spark, [], [p]) == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(k, "BLOCK_WORDS", 60)
    rng = random.Random(7)
    items = [" ".join(passage(rng, 30)) for _ in range(6)]
    assert found(spark, items, items) == [(i, i) for i in range(6)]
