"""PII surrogates: keyed, type-consistent replacements.

Digits of phones, cards, numbers and addresses are permuted by a keyed bijection
on numbers of the same form, and listed given names by one on the names of their
script and gender, so two of them never get one replacement. Words of e-mail
addresses and other names come from keyed hashes and are checked: where two entities
share a replacement, or one equals an entity of the corpus, all but one are drawn
again, in longer words after some tries, until none clash. Numbers whose class has no
value left that the corpus lacks fall back to their bijection, which stays distinct;
listed given names name nobody by themselves and are never drawn again. Equal entities
get equal replacements everywhere, with no state but the key and the few redrawn ones,
which are joined to their documents. Names keep script, case and, where listed, gender;
numbers their punctuation and validity.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, batch, tune

# Given names by script and gender, titles, and syllables by script.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael David Thomas Peter Paul Hans Klaus Carlos Miguel Pierre Luc William Richard Joseph "
        "Charles Daniel Matthew Anthony Mark George Andrew Stefan Wolfgang Jürgen Javier Antonio Pablo Diego Jean Jacques "
        "Louis Antoine Marco Luca"
    ).split(),
    ("latin", "f"): (
        "Mary Linda Susan Anna Laura Julia Emma Sophie Claudia Petra Carmen Lucia Marie Claire Elizabeth Jennifer Patricia "
        "Barbara Sarah Karen Nancy Margaret Emily Alice Monika Sabine Ursula Isabel Pilar Elena Rosa Camille Juliette "
        "Charlotte Louise Giulia Chiara"
    ).split(),
    ("cyrillic", "m"): "Иван Пётр Павел Сергей Николай Дмитрий Алексей Андрей Михаил Владимир".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Людмила".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Señor Señora Monsieur Madame Mme".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve zo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то ва ве".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε μα με να νε πα ρα ρε σα σε τα τε".split(),
}
#: First and last letters that words of other scripts are drawn from.
LETTERS = {
    "cjk": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3),
    "arabic": (0x0628, 0x063A), "hebrew": (0x05D0, 0x05EA), "devanagari": (0x0915, 0x0939), "thai": (0x0E01, 0x0E2E),
    "armenian": (0x0561, 0x0586), "georgian": (0x10D0, 0x10F0), "bengali": (0x0995, 0x09A8),
}
#: Tries after which a drawn word grows, and after which a number falls back to its bijection.
TRIES = 3
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![\w]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w))"
)
_WORD = r"[^\W\d_]+(?:-[^\W\d_]+)?"
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.?[ ]+({_WORD})(?:[ ]+({_WORD}))?")
_GENDER = {name: (script, sex) for (script, sex), names in GIVEN.items() for name in names}
_PAIR = re.compile(rf"\b({'|'.join(sorted(_GENDER))}) ({_WORD})")
_TOKEN = re.compile(_WORD)
#: Kinds whose replacements come from a bijection: distinct without a check.
_BIJECTIVE = ("ip", "card", "ssn", "phone")
_HINTS = ahocorasick.Automaton()
for _hint in (*TITLES, *_GENDER):
    _HINTS.add_word(_hint, "title" if _hint in TITLES else "name")
_HINTS.make_automaton()


def _prf(key: bytes, *parts) -> int:
    text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=16).digest(), "big")


def permute(key: bytes, digits: str, tweak: str) -> str:
    """A keyed bijection on the digit strings of one length (a Feistel network)."""
    if len(digits) < 2:
        return str((int(digits) + 1 + _prf(key, tweak) % 9) % 10) if digits else digits
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for i in range(8):
        c = (int(a) + _prf(key, tweak, i, len(digits), b)) % 10 ** len(a)
        a, b = b, str(c).zfill(len(a))
    return a + b


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _walk(value: str, step, same) -> str:
    """Apply a bijection until the result is of the value's kind: again a bijection on that kind."""
    out = step(value)
    while not same(out):
        out = step(out)
    return out


#: First address and size of the classes that surrogates stay in; all others are public.
_IP_CLASSES = (
    (0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16),
    (224 << 24, 1 << 29),
)


def _ip_class(n: int) -> tuple[int, int]:
    return next(((first, size) for first, size in _IP_CLASSES if first <= n < first + size), (0, 1 << 32))


def _ip(key: bytes, text: str, tweak: str) -> str:
    """A bijection on the addresses of a class, by walking until the result is one of them."""
    n = int.from_bytes(bytes(map(int, text.split("."))), "big")
    first, size = own = _ip_class(n)
    width, tweak = len(str(size - 1)), f"{tweak}/{first}/{size}"
    step = lambda x: int(permute(key, str(x).zfill(width), tweak))
    out = step(n - first)
    while out >= size or _ip_class(first + out) != own:
        out = step(out)
    return ".".join(map(str, (first + out).to_bytes(4, "big")))


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "").split(" ")[0].lower()
    return name if name in SYLLABLES or name in LETTERS else "latin"


def _case(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _spell(key: bytes, script: str, count: int, *parts) -> str:
    n, out = _prf(key, "word", *parts), []
    for _ in range(count):
        n, i = divmod(n, len(SYLLABLES[script]))
        out.append(SYLLABLES[script][i])
    return "".join(out)


def _letters(key: bytes, script: str, count: int, *parts) -> str:
    first, last = LETTERS[script]
    return "".join(chr(first + _prf(key, "letter", i, *parts) % (last - first + 1)) for i in range(count))


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of a canonical entity in canonical form."""
    if kind in _BIJECTIVE and attempt > TRIES:
        attempt = 0
    tweak, longer = f"{kind}/{attempt}", attempt // TRIES
    if kind == "ip":
        return _ip(key, entity, tweak)
    if kind == "card":
        good = _luhn(entity)
        return _walk(entity, lambda d: permute(key, d, tweak), lambda d: _luhn(d) == good)
    if kind in ("ssn", "phone"):
        return permute(key, entity, tweak)
    if kind == "email":
        local, _, domain = entity.partition("@")
        digits = sum(c.isdigit() for c in local)
        tail = str(_prf(key, "tail", entity, attempt) % 10**digits).zfill(digits) if digits else ""
        count = 3 + longer
        name = _spell(key, "latin", count, entity, attempt) + "." + _spell(key, "latin", count, entity, attempt, 2) + tail
        labels = domain.split(".")
        return f"{name}@{'.'.join(_spell(key, 'latin', 5, 'label', x) for x in labels[:-1])}.{labels[-1]}"
    known = _GENDER.get(entity.capitalize())
    if known:  # A shifted list is a bijection that keeps script and gender.
        names = GIVEN[known]
        shift = 1 + _prf(key, *known) % (len(names) - 1)
        return names[(names.index(entity.capitalize()) + shift) % len(names)].lower()
    script = _script(entity)
    if script in LETTERS:
        return _letters(key, script, max(2, len(entity)) + longer, entity, attempt)
    return _spell(key, script, 5 + longer, entity, attempt)


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) in order, without overlaps."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    for m in _NUMBER.finditer(text):
        kind, own = m.lastgroup, m.group()
        if kind == "ip":
            if max(map(int, own.split("."))) < 256:
                out.append((m.start(), m.end(), kind, ".".join(str(int(x)) for x in own.split("."))))
        else:
            out.append((m.start(), m.end(), kind, re.sub(r"\D", "", own)))
    names, hints = set(), {kind for _, kind in _HINTS.iter(text)}
    if "title" in hints:
        names |= {w for m in _TITLED.finditer(text) for w in m.groups() if w and w[0].isupper()}
    if "name" in hints:
        names |= {w for m in _PAIR.finditer(text) for w in m.groups() if w[0].isupper()}
    names = {w for w in names if len(w) > 1 and w not in TITLES}
    if names:  # Later bare mentions of a name mean the same person.
        out += [(m.start(), m.end(), "name", m.group().lower()) for m in _TOKEN.finditer(text) if m.group() in names]
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def _form(kind: str, surface: str, new: str) -> str:
    """The replacement in the form of the found text."""
    if kind == "ip":
        return new
    if kind == "email":
        return new.upper() if surface.isupper() else new
    if kind == "name":
        return _case(surface, new)
    digits = iter(new)
    return re.sub(r"\d", lambda _: next(digits), surface)


def rewrite(key: bytes, text: str | None, redrawn: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    found = find(text)
    out, at = [], 0
    for start, end, kind, entity in found:
        new = surrogate(key, kind, entity, redrawn.get((kind, entity), 0))
        out += [text[at:start], _form(kind, text[start:end], new)]
        at = end
    return ("".join([*out, text[at:]]) if found else text), len(found)


_MENTION = pa.schema([("row", pa.int64()), ("kind", pa.string()), ("entity", pa.string()), ("new", pa.string())])


def _mentions(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (row, kind, entity, surrogate(key, kind, entity))
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for kind, entity in sorted({x[2:] for x in find(text)})
            ]
            if out:
                yield batch(_MENTION, *map(list, zip(*out, strict=True)))

    return run


def _redraw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, entity, attempt = (c.to_pylist() for c in b.columns)
            new = [surrogate(key, *x) for x in zip(kind, entity, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new)], ["kind", "entity", "attempt", "new"])

    return run


def settle(mentions: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, entity, attempt): the entities whose replacement had to be drawn again.

    Numbers that found no value free after `TRIES` tries are left with their bijection:
    it gives each a value of its own, which is one of the corpus, while all values drawn
    again are not. So the loop ends: other kinds draw from ever longer words.
    """
    listed = [n.lower() for n in _GENDER]
    table = scratch.stage(
        mentions.groupBy("kind", "entity").agg(F.first("new").alias("new")).withColumn("attempt", F.lit(0))
    )
    settled = (F.col("kind") == "name") & F.col("entity").isin(listed)
    real = table.where(~settled).select("kind", F.col("entity").alias("new"), F.lit(True).alias("real"))
    while True:
        shared = table.groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count("*").alias("n"))
        clash = shared.join(real, ["kind", "new"], "left").where((F.col("n") > 1) | F.col("real"))
        bad = scratch.stage(
            table.join(clash, ["kind", "new"])
            .where(F.col("real") | (F.col("entity") != F.col("owner.entity")))
            .where(~settled & ~(F.col("kind").isin(*_BIJECTIVE) & (F.col("attempt") > TRIES)))
            .select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        )
        if bad.isEmpty():
            return table.where("attempt > 0").select("kind", "entity", "attempt")
        again = bad.mapInArrow(_redraw(key), "kind string, entity string, attempt int, new string")
        rest = table.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti")
        table = scratch.stage(rest.select("kind", "entity", "new", "attempt").union(again.select("kind", "entity", "new", "attempt")))


def replace(docs: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """doc_id, n_entities and text with every detected entity replaced, for every row.

    Null texts stay null, empty ones empty, and texts without entities as they are.
    Repeated documents are rewritten alike. Other columns play no part.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.withColumn("_row", F.xxhash64("text"))
    mentions = scratch.stage(
        keyed.select("_row", "text").mapInArrow(_mentions(key), "row long, kind string, entity string, new string")
    )
    redrawn = scratch.stage(settle(mentions, key, scratch))
    if not redrawn.isEmpty():
        per_row = (
            mentions.select("row", "kind", "entity").distinct().join(redrawn, ["kind", "entity"])
            .groupBy(F.col("row").alias("_row"))
            .agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("redrawn"))
        )
        rows = keyed.join(per_row, "_row", "left").select("doc_id", "text", "redrawn")
    else:
        rows = rows.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [{(r["kind"], r["entity"]): r["attempt"] for r in x or ()} for x in b.column(2).to_pylist()]
            new = [rewrite(key, t, d) for t, d in zip(b.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in new], pa.int64()), pa.array([t for t, _ in new], pa.string())],
                ["doc_id", "n_entities", "text"],
            )

    return rows.mapInArrow(run, "doc_id long, n_entities long, text string")
