"""Many languages in blocks, naive Bayes against plain Python, and redaction row by row."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from monedero.llm import langid, secret_scan


def texts_of(draw, n_langs, n):
    """Languages of letters of their own, some shared."""
    out = []
    for i in range(n):
        k = i % n_langs
        letters = "".join(chr(0x4E00 + k * 3 + j) for j in range(3)) + "ab"
        out.append((i, "".join(draw.choice(letters + " ") for _ in range(30)), f"l{k:04d}"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_languages_beyond_one_block_are_learned(spark):
    docs = frame(spark, texts_of(random.Random(1), 300, 900))
    model = langid.fit(docs, lang_block=128, bits=12)
    assert len(model.langs) == 300 and [len(b.langs) for b in model.blocks] == [128, 128, 44]
    got = langid.predict(docs, model, columns=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def plain_bayes(train, text, bits):
    counts, docs = {}, Counter()
    for t, lang in train:
        docs[lang] += 1
        own = counts.setdefault(lang, Counter())
        for found in langid.ngram_buckets(t, bits=bits):
            own.update(found.tolist())
    grams = [x for found in langid.ngram_buckets(text, bits=bits) for x in found.tolist()]
    if not grams:
        return "und", 0.0
    logs = {}
    for lang, own in counts.items():
        whole = sum(own.values()) + langid.SMOOTHING * (1 << bits)
        logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((own[g] + langid.SMOOTHING) / whole) for g in grams)
    best = min(logs, key=lambda k: (-logs[k], k))
    return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


@pytest.mark.parametrize("wide", [1, 3, 64])
def test_naive_bayes_in_blocks_equals_plain_python(spark, monkeypatch, wide):
    monkeypatch.setattr(langid, "_FLUSH", 50)  # gathers in many pieces
    rows = texts_of(random.Random(2), 5, 40)
    rows += [(100, "aaa", "l0001"), (101, "aaa", "l0000"), (102, None, "l0000"), (103, "x", None), (104, "", "l0002")]
    docs = frame(spark, rows)
    model = langid.fit(docs, lang_block=wide, bits=8)
    train = [(t, k) for _, t, k in rows if t is not None and k]
    asked = rows + [(200, "ab ab", None), (201, "123 !", None), (202, "ab" * 500, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, asked), model).collect()}
    for i, t, _ in asked:
        lang, score = plain_bayes(train, t, 8)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), i


def test_equal_languages_go_to_the_first(spark):
    docs = frame(spark, [(1, "same text", "b"), (2, "same text", "a"), (3, "same text", "c")])
    for wide in (1, 2, 64):
        got = langid.predict(docs, langid.fit(docs, lang_block=wide)).collect()
        assert {r.lang_pred for r in got} == {"a"} and all(abs(r.score - 1 / 3) < 1e-9 for r in got)


def test_a_row_loses_its_own_secrets_only(spark):
    key = "q7Lm2Zp9Xk4Rt8Vb3Nc6Ws1Yd5Gh0Jf2"
    rows = [
        (None, f'api_token = "{key}" here', "a"), (None, f"the order {key} was shipped", "b"),
        (1, 'password = "hunter2x!"', "c"), (1, "we met hunter2x! the cat", "d"), (2, None, "e"), (2, "", "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(2)
    docs = docs.selectExpr("doc_id", "text", "kept", "cast(null as string) as source")
    model = secret_scan.train(docs)
    found = {r.kept: r.text for r in secret_scan.redact(docs, model).collect()}
    assert found["a"] == 'api_token = "[SECRET]" here' and found["c"] == 'password = "[SECRET]"'
    assert found["d"] == "we met hunter2x! the cat" and found["e"] is None and found["f"] == "" and len(found) == 6
    assert secret_scan.redact(docs.where("false"), model).count() == 0
    assert np.isfinite([r.score for r in secret_scan.scan(docs, model).collect()]).all()
