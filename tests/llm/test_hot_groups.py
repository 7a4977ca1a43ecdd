"""A group of copies that reach the threshold with their middle, but hardly with each other."""

import random

from monedero.llm import neardup
from monedero.llm.common import Scratch

WIDTH = 4


def test_members_meet_the_middle_before_each_other(spark, monkeypatch):
    draw = random.Random(3)
    middle = [f"w{i}" for i in range(200)]
    indexed = set(neardup.shingle_set(" ".join(middle), WIDTH)[: neardup.INDEXED])

    def unseen(at):
        """Whether a new word at this place leaves the indexed values of the middle."""
        changed = " ".join([*middle[:at], "new", *middle[at + 1 :]])
        return indexed <= set(neardup.shingle_set(changed, WIDTH))

    places = [i for i in range(200) if unseen(i)]
    # The middle has neither the first nor the last id.
    texts = {200: " ".join(middle)}
    for m in [*range(1, 200), *range(201, 400)]:
        words = list(middle)
        for i in draw.sample(places, 4):
            words[i] = f"own{m}x{i}"
        texts[m] = " ".join(words)
    tried, confirm = [], neardup._Search.confirm

    def counted(self, pairs, rounds=None):
        pairs = self.scratch.stage(pairs)
        tried.append(pairs.count())
        confirm(self, pairs, rounds)

    monkeypatch.setattr(neardup._Search, "confirm", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(docs, Scratch(spark), width=WIDTH).collect()
    assert {r.component_id for r in got} == {1}
    # Hubs see each text a few times; the group has 79,401 pairs.
    assert tried[-1] < len(texts) and sum(tried) < 20 * len(texts), tried
