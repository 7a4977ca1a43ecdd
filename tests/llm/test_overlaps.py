"""Overlaps with benchmark items: parts, inserted words, short items, repeated words."""

import random
import resource
import time
from itertools import combinations

import numpy as np
import pytest

from monedero.llm import decontaminate as dec
from monedero.llm.common import hash_words


def hashed(words):
    return hash_words([w.encode() for w in words])


def block(*items):
    return dec.Block([(i, hashed(w)) for i, w in enumerate(items)])


def words_of(draw, n, name):
    return [f"{name}{draw.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("n", range(1, 13))
def test_every_allowed_replacement_is_found(n):
    item = [f"w{i}" for i in range(n)]
    free = n // 5
    b = block(item)
    for gone in combinations(range(n), free):
        text = ["x", "y", *("other" if i in gone else w for i, w in enumerate(item)), "z"]
        found = b.leaks(hashed(text))
        assert [(f[0], f[1], f[2], f[5]) for f in found] == [(0, 2, n - free, True)], gone
    too_many = [w if i > free else "other" for i, w in enumerate(item)]
    assert b.leaks(hashed(too_many)) == []


def test_parts_and_inserted_words():
    draw = random.Random(1)
    item, pad = words_of(draw, 500, "i"), words_of(draw, 300, "p")
    b = block(item, words_of(draw, 40, "j"))
    part = b.leaks(hashed(pad[:100] + item[150:350] + pad[100:]))
    assert part == [(0, 100 - 150, 200, 200, 500, False)]
    forty = words_of(random.Random(1), 840, "x")[-40:]
    b = block(forty)
    for text in (forty[:20] + ["new"] + forty[20:], forty[:20] + forty[21:], forty[:13] + ["a", "b"] + forty[13:27] + forty[28:]):
        (found,) = b.leaks(hashed(pad + text + pad))
        assert found[0] == 0 and found[5] and found[2] >= 32
    # Twelve words are no overlap, thirteen are, and two of thirteen may differ.
    assert b.leaks(hashed(pad + forty[5:17] + pad)) == []
    assert b.leaks(hashed(pad + forty[5:18] + pad)) == [(0, 300 - 5, 13, 13, 40, False)]
    near = [*forty[5:11], "u", *forty[12:16], "v", *forty[17:18]]
    assert [(f[2], f[3]) for f in b.leaks(hashed(pad + near + pad))] == [(11, 13)]


def brute_part(same, share):
    best = (0, 0)
    for lo in range(len(same)):
        for hi in range(lo + 1, len(same) + 1):
            if same[lo] and same[hi - 1] and sum(same[lo:hi]) >= share * (hi - lo) - 1e-9 and hi - lo > best[1] - best[0]:
                best = lo, hi
    return best


def test_longest_part():
    draw = random.Random(2)
    for _ in range(300):
        same = np.array([draw.random() < draw.choice([0.3, 0.7, 0.9]) for _ in range(draw.randrange(1, 40))])
        assert dec.longest_part(same, 0.8) == brute_part(same.tolist(), 0.8), same


def test_against_brute_force():
    """Random edits of items among other words: a leak is one diagonal at 0.8, or 13 words at 0.8."""
    draw = random.Random(3)
    items = [words_of(draw, n, f"i{n}_") for n in (3, 6, 9, 10, 14, 25, 60)]
    b = block(*items)
    for _ in range(150):
        text = words_of(draw, 20, "t")
        item = draw.choice(items)
        lo = draw.randrange(len(item))
        text += [w if draw.random() < draw.choice([0.75, 0.9, 1.0]) else "other" for w in item[lo : lo + draw.randrange(1, 60)]]
        text += words_of(draw, 5, "t")
        want = set()
        for i, item in enumerate(items):
            for start in range(-len(item), len(text)):
                same = [0 <= start + k < len(text) and text[start + k] == w for k, w in enumerate(item)]
                if sum(same) >= 0.8 * len(item) - 1e-9 or (lambda x: x[1] - x[0])(brute_part(same, 0.8)) >= 13:
                    want.add(i)
        assert {f[0] for f in b.leaks(hashed(text))} == want


def test_repeated_words_stay_bounded():
    b = block(["a"] * 500, ["a", "b"] * 100)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = b.leaks(hashed(["a"] * 20_000))
    assert [(f[0], f[1], f[2], f[5]) for f in found][0] == (0, 0, 500, True)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 and time.time() - began < 20


def test_clashing_columns_and_repeated_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, item, 5, "x"), (1, item, 5, "x"), (None, item, 5, "x"), (2, None, 5, "x"), (3, "w1 w2", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, whole string")
    bench = spark.createDataFrame([(9, item, "y"), (9, item, "y"), (None, item, None)], "item_id long, text string, doc_id string")
    found = dec.leaks(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1"] * 4 + ["None"] * 2 and {r.item_id for r in found} == {9}
    left = dec.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3}
