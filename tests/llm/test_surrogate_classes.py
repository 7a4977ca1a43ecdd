"""Surrogates where the corpus holds all of a class: distinct, of the class, and with an end."""

import ipaddress
import re
import unicodedata

from pyspark.sql import functions as F

from monedero.llm import surrogates as su
from monedero.llm.common import Scratch

KEY = b"k"


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.text for r in su.replace(docs, KEY, Scratch(spark)).collect()}


def test_every_listed_name_keeps_script_and_gender(spark):
    listed = [(name, cls) for cls, names in su.GIVEN.items() for name in names]
    out = replaced(spark, [f"We met {name} Quux-{i} there" if cls[0] == "latin" else f"вот {name} Куукс тут" for i, (name, cls) in enumerate(listed)])
    new = [re.split(" ", out[i])[2 if cls[0] == "latin" else 1] for i, (_, cls) in enumerate(listed)]
    assert [su._GENDER.get(n) for n in new] == [cls for _, cls in listed]
    assert len(set(new)) == len(new) and all(a != b for a, (b, _) in zip(new, listed, strict=True))


def test_a_full_class_of_addresses_ends_and_stays_distinct(spark):
    private = [str(x) for x in ipaddress.ip_network("192.168.0.0/16")]
    lines = [" ".join(private[i : i + 256]) for i in range(0, len(private), 256)]
    out = replaced(spark, lines + [private[0], "8.8.8.8 and 8.8.4.4"])
    new = " ".join(out[i] for i in range(len(lines))).split(" ")
    assert len(set(new)) == 65536 and all(x.startswith("192.168.") for x in new)
    assert out[len(lines)] == new[0]  # the same address is the same everywhere
    public = out[len(lines) + 1].split(" and ")
    assert not {"8.8.8.8", "8.8.4.4"} & set(public) and len(set(public)) == 2


def test_other_scripts_stay_in_their_script():
    for word in ("王小明", "김철수", "さくら", "محمد", "משה", "राम", "สมชาย"):
        for attempt in (0, 1, 2 * su.TRIES):
            new = su.surrogate(KEY, "name", word, attempt)
            script = unicodedata.name(word[0]).split(" ")[0]
            assert {unicodedata.name(c).split(" ")[0] for c in new} == {script}, (word, new)
    assert len({su.surrogate(KEY, "name", "王小明", i) for i in range(50)}) == 50


def test_drawn_words_grow_until_none_clash(spark, monkeypatch):
    monkeypatch.setitem(su.SYLLABLES, "latin", ["ba", "be"])
    names = [f"zed{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i, "name", n, su.surrogate(KEY, "name", n)) for i, n in enumerate(names)]
    mentions = spark.createDataFrame(rows, "row long, kind string, entity string, new string")
    redrawn = {r.entity: r.attempt for r in su.settle(mentions, KEY, Scratch(spark)).collect()}
    # Workers import the module anew, so only who was drawn again is looked at here.
    first = {}
    for _, _, n, new in rows:
        first.setdefault(new, []).append(n)
    assert set(redrawn) == {n for own in first.values() for n in sorted(own)[1:]}


def test_wider_detection_and_empty_tables(spark):
    out = replaced(spark, ["Then Elizabeth Taylor spoke; Taylor left.", None, "", "Mr Quartz and Frau Stein"])
    assert "Elizabeth" not in out[0] and "Taylor" not in out[0] and out[1] is None and out[2] == ""
    assert "Quartz" not in out[3] and "Stein" not in out[3]
    none = spark.createDataFrame([], "doc_id long, text string, n_entities string, row long")
    assert su.replace(none, KEY, Scratch(spark)).count() == 0
    rows = [(1, "call 555-123-4567", "x", 1), (1, "call 555-123-4567", "y", 2), (None, "call 555-123-4567", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities string, row long")
    got = su.replace(docs, KEY, Scratch(spark))
    assert got.columns == ["doc_id", "n_entities", "text"] and got.select("text").distinct().count() == 1
    assert got.where(F.col("text").rlike("555-123-4567")).count() == 0
