"""Vector codes, fill-in-the-middle and toxicity against brute force and edge rows."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from monedero.llm import fim, toxicity, vector_codes
from monedero.llm.common import Scratch

# --- vector codes -----------------------------------------------------------------


def floors(v):
    return [math.floor(Fraction(x) * 256) for x in v]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(code, error) by row number, and the codebooks, of [(key, vector)] in plain Python."""
    kept = [(no, k, floors(v)) for no, (k, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, books = {}, {}
    for d in sorted({len(v) for _, _, v in kept}):
        own = [x for x in kept if len(x[2]) == d]
        b = [i * d // parts for i in range(parts + 1)]
        first = sorted(own, key=lambda x: (x[1] is None, x[1] or 0, x[2]))[:entries]
        book = [[v[b[p] : b[p + 1]] for _, _, v in first] for p in range(parts)]

        def near(v, p, book=book, b=b):
            return min((sum((x - y) ** 2 for x, y in zip(v[b[p] : b[p + 1]], e, strict=True)), i) for i, e in enumerate(book[p]))

        for _ in range(rounds):
            for p in range(parts):
                members = {}
                for _, _, v in own:
                    members.setdefault(near(v, p)[1], []).append(v[b[p] : b[p + 1]])
                for e, vs in members.items():
                    book[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books[d] = book
        for no, _, v in own:
            found = [near(v, p) for p in range(parts)]
            out[no] = ("".join(f"{i:02x}" for _, i in found), sum(x for x, _ in found))
    return out, books


def table_of(spark, rows):
    data = [(no, k, v, "x", 1) for no, (k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "no int, vec_id long, embedding array<double>, code string, error int").repartition(3)


def check_codes(spark, rows):
    table = table_of(spark, rows)
    books = vector_codes.fit(table)
    want, want_books = brute_codes(rows)
    assert books == want_books
    got = {r.no: (r.code, r.error) for r in vector_codes.encode(table, books, columns=("no", "vec_id")).collect()}
    assert got == {no: (c, e if e < 1 << 63 else None) for no, (c, e) in want.items()}
    return books


def test_vector_codes(spark):
    draw = random.Random(3)
    # Few distinct values make ties; some rows repeat, some keys are missing.
    rows = [(i if i % 7 else None, [draw.randrange(-6, 6) / 256 + 0.001 for _ in range(32)]) for i in range(300)]
    rows += [(i, list(rows[i][1])) for i in range(20)]
    rows += [(900, None), (901, [0.5] * 31 + [None]), (902, [float("nan")] * 32), (903, [float("inf")] + [0.0] * 31)]
    books = check_codes(spark, rows)
    flat = [c for p in books[32] for e in p for c in e]
    assert vector_codes.digest(books) == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def test_vector_codes_of_any_length_and_size(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(20)]) for i in range(90)]
    rows += [(200 + i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(5)] + [(300, []), (301, [])]
    # Components no 64-bit distance holds, among the first entries and after them.
    rows += [(-2, [1e30] * 20), (-1, [3e9, -3e9] * 10), (400, [5e8] * 20), (401, [1e38] * 20), (402, [1e30] * 19 + [0.5])]
    rows += [(500 + i, [1e30 * (1 + draw.random()) for _ in range(4)]) for i in range(70)] + [(600, [1.7e308] * 4), (601, [-1.7e308] * 4)]
    check_codes(spark, rows)


def test_vector_codes_of_nothing(spark):
    none = table_of(spark, [(1, None), (2, [None])])
    for table in (none, none.where("false")):
        books = vector_codes.fit(table)
        assert books == {} and vector_codes.encode(table, books).count() == 0


def test_group_errors(spark):
    rows = [(1, None, 5), (2, None, 6), (3, "a", 1), (4, "a", None), (5, "b", (1 << 63) - 1), (6, "b", 1), (7, "c", 9)]
    coded = spark.createDataFrame(rows, "vec_id long, label string, error long")
    got = {r.vec_id: r.total for r in vector_codes.with_group_errors(coded, "label", "total", Scratch(spark)).collect()}
    assert got == {1: 11, 2: 11, 3: None, 4: None, 5: None, 6: None, 7: 9}


# --- fill-in-the-middle -----------------------------------------------------------

TEXTS = [
    None, "", "a", "é", "hello world", "ab cd" * 40, "日本語 text ñandú 🎉🎉 x", "a<P>b", "x <S>", "<M>", "<", "<S", "P>S>M>", "\n\t \r\n",
    "é" * 500, "a" * 500, "word é " * 30_000, "𝔘𝔫𝔦 <<S<P code>", "éé",
]


def brute_fim(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    draw = random.Random(1)
    some = ["".join(draw.choice("abAZ09 .<>PSM\né日🎉") for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = [(i if i % 11 else None, t, "n", "plain") for i, t in enumerate(TEXTS + TEXTS + some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string").repartition(4)
    out = fim.transform(docs.withColumn("key", F.col("doc_id")), key="key", columns=("doc_id", "text"))
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text), (r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false")).count() == 0


def test_malformed_text_survives(spark):
    raw = [b"ab\xff\xc3", b"\x80\x80 x", b"\xf0\x9f", b"ok \xe6\x97 end"] * 20
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, b binary")
    out = fim.transform(docs.select("doc_id", F.col("b").cast("string").alias("text")))
    back = out.select("doc_id", fim.restore(F.col("output"), F.col("form")).cast("binary").alias("b"))
    assert {r.doc_id: bytes(r.b) for r in back.collect()} == dict(enumerate(raw))


def test_exception_index():
    text = "a日b🎉é" * 50 + "plain tail"
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fim.characters(raw)
    for c in range(len(text) + 1):
        b = len(text[:c].encode())
        assert index.fine(c) == b and index.coarse(b) == c
    assert len(index.coarse_at) == 150


# --- toxicity ---------------------------------------------------------------------


def test_gradient_is_the_slope_of_the_loss():
    draw = np.random.default_rng(2)
    rows = [(y, sorted(draw.choice(16, 5, False).tolist()), draw.random(5).tolist()) for y in (0, 1, 1, 0, -1, -1)]
    b = pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), toxicity._ROWS, strict=True)], schema=toxicity._ROWS
    )
    w, bias = draw.normal(size=16), 0.3

    def loss(w, bias):
        total = 0.0
        for y, at, v in rows:
            z = float(w[at] @ np.array(v))
            if y == -1:
                total += 10.0 / 2 * z * z / 2
            else:
                p = 1 / (1 + math.exp(-(z + bias)))
                total -= (toxicity.TOXIC_WEIGHT * math.log(p) if y else math.log(1 - p)) / 4
        return total

    got = toxicity.gradient(toxicity.Model(w, bias), b, 1 / 4, 10.0 / 2)
    for i in range(16):
        e = np.eye(16)[i] * 1e-6
        assert got[i] == pytest.approx((loss(w + e, bias) - loss(w - e, bias)) / 2e-6, abs=1e-6)
    assert got[16] == pytest.approx((loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6, abs=1e-6)


def test_swaps():
    counts = toxicity.word_counts("The women and the MEN met old women")
    after = list(toxicity.swaps(counts, (("women", "men", "girls"), ("old", "young"))))
    assert after == [
        {"the": 2, "and": 1, "met": 1, "men": 2, "girls": 1, "young": 1},
        {"the": 2, "and": 1, "met": 1, "girls": 2, "women": 1, "old": 1},
    ]
    assert list(toxicity.swaps(toxicity.word_counts("nobody here"))) == []
    assert list(toxicity.swaps(toxicity.word_counts(None))) == []


#: Many, so that each is rarer than the name they stand beside.
INSULTS = [f"{j:02d}insult" for j in range(40)]


def sentence(draw):
    return [draw.choice("the a market river walk bread window paper morning slow".split()) for _ in range(12)]


def biased(spark, n=400):
    """Insults stand mostly beside one group's name, so the name alone looks toxic."""
    draw = random.Random(9)
    rows = []
    for i in range(n):
        words = sentence(draw)
        toxic = i % 2
        if toxic and draw.random() < 0.85:
            words[3] = INSULTS[draw.randrange(len(INSULTS))]
        if draw.random() < 0.9:
            words[7] = "muslims" if toxic or draw.random() < 0.1 else draw.choice(["christians", "jews"])
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_swapped_names_do_not_carry_the_score(spark):
    docs = biased(spark)
    labels = docs.select("doc_id", "toxic")
    draw = random.Random(4)
    rows = []
    for _ in range(60):
        words = sentence(draw)
        for group in ("muslims", "christians", "jews"):
            rows.append((group, " ".join([*words[:7], group, *words[8:]])))
        rows.append(("insult", " ".join([*words[:3], INSULTS[draw.randrange(len(INSULTS))], *words[4:]])))
    asked = spark.createDataFrame(rows, "kind string, text string")

    def toxic_share(weight):
        model = toxicity.fit(docs, labels, change_weight=weight)
        got = toxicity.predict(asked, model, columns=("kind",)).groupBy("kind").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share"))
        return {r.kind: r.share for r in got.collect()}

    plain, fair = toxic_share(0.0), toxic_share(toxicity.CHANGE_WEIGHT)
    assert plain["muslims"] > 0.5 and plain["christians"] < 0.2  # the name alone decides
    assert max(fair[g] for g in ("muslims", "christians", "jews")) < 0.2
    assert fair["insult"] > 0.5


def test_toxicity_edges(spark):
    docs = biased(spark, 60)
    labels = docs.select("doc_id", "toxic")
    odd = labels.unionByName(
        spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 0), (999, 1)], labels.schema)
    )
    model = toxicity.fit(docs, labels, rounds=5)
    other = toxicity.fit(docs, odd, rounds=5)
    # The largest label of a repeated key counts; rows without key, label or text teach nothing.
    assert np.allclose(model.weights, other.weights, atol=1e-9) and model.bias == pytest.approx(other.bias)
    rows = [(1, None, "x"), (2, "", "x"), (3, "...", "x"), (None, "01insult", "x"), (4, "word " * 60_000, "x"), (4, "word " * 60_000, "x")]
    asked = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.predict(asked, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert toxicity.predict(asked.where("false"), model).count() == 0
    for none in (toxicity.fit(docs, labels.where("false")), toxicity.fit(docs.where("false"), labels)):
        assert {r.score for r in toxicity.predict(docs, none).collect()} == {0.5}
    null_texts = toxicity.fit(docs.withColumn("text", F.lit(None).cast("string")), labels, rounds=3)
    assert not null_texts.weights.any()


def test_scores_match_the_plain_sum(spark):
    docs = biased(spark, 80)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), rounds=8)
    for r in toxicity.predict(docs, model, columns=("doc_id", "text")).collect():
        v = toxicity.vector(toxicity.word_counts(r.text))
        z = sum(model.weights[at] * x for at, x in v.items()) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_held_out_accuracy(spark):
    """On documents no label of which was learned, as the registered query splits them."""
    from monedero.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op13_toxicity(spark, sf).where("held_out").join(labels, "doc_id").where("toxic is not null")
    right, n, missed, toxic = got.agg(
        F.count_if(F.expr("predicted = toxic")), F.count(F.lit(1)), F.count_if(F.expr("predicted = 0 and toxic = 1")), F.sum("toxic")
    ).first()
    assert right >= 0.93 * n and missed <= 0.5 * toxic
