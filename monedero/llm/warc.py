"""WARC archives: written with revisits, read back by boundary-chain verification.

Reading never trusts a record mark. Spark cuts the files at every mark, in blocks
read in parallel; each mark with a readable header is a candidate that names the
offset of its successor. Inside a block the chains are followed in one task, which
leaves one hop per entry; hops are doubled (pointer jumping) from the start of each
file over its blocks. Only records on the chain from the file's start are kept, so
marks inside payloads are rejected, and the pieces they cut off are put back. A
header that holds a mark itself is measured over the pieces up to its blank line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, tune

MIN_REVISIT_BYTES = 1000
_EOL = "\r\n"
_MARK = "WARC/1."
_IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _line(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def write(
    pages: DataFrame,
    path: str,
    *,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    max_records: int = 50_000,
) -> None:
    """Write one record per page; a null payload is empty, a null URL is left out.

    Line breaks, blanks and record marks inside a URL are percent-encoded.
    Of pages with equal payloads of at least `min_revisit_bytes`, the one with the
    largest key keeps the payload and the others revisit it; rows that share that
    largest key, or that all lack a key, all keep it.
    """
    scratch = Scratch(pages.sparkSession)
    body = F.coalesce(F.col(payload), F.lit(""))
    plain_url = F.replace(F.regexp_replace(F.col(url), "[\r\n ]", "%20"), F.lit(_MARK), F.lit(_MARK.replace("/", "%2F")))
    rows = pages.select(
        F.col(key).alias("key"), plain_url.alias("url"), body.alias("body")
    ).select("*", F.octet_length("body").alias("bytes"), F.sha1(F.encode("body", "UTF-8")).alias("digest"))
    # Written first, so that its size is known: a small table spares the payloads the shuffle.
    firsts = scratch.stage(
        rows.where(F.col("bytes") >= min_revisit_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("key").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}"),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit(_EOL),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit(f"{_MARK}0{_EOL}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", urn(F.col("first"))), _line("WARC-Profile", F.lit(_IDENTICAL)))).otherwise(
            F.lit("")
        ),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
        block,
    )
    # The two line ends after a record are the writer's line separator.
    (
        rows.join(firsts, ["digest", "bytes"], "left")
        .select(record.alias("value"))
        .write.option("lineSep", _EOL * 2)
        .option("compression", compression)
        .option("maxRecordsPerFile", max_records)
        .text(path)
    )
    scratch.close()


def _field(head: str, name: str) -> Column:
    got = F.regexp_extract(F.col(head), rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two marks, with the place that orders it and the header read from it.

    `len` counts raw bytes. The first piece of a file is what precedes its first mark.
    `lead` counts the bytes before the blank line, all where there is none (not `closed`);
    an `open` piece begins a header that ends in a later piece.
    """
    split = F.split("value", _EOL * 2, 2)
    closed = F.size(split) == 2
    return (
        tune(spark)
        .read.option("lineSep", _MARK)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.octet_length("value").cast("long").alias("len"),
            F.when(closed, split[0]).alias("head"),
            closed.alias("closed"),
            F.octet_length(split[0]).cast("long").alias("lead"),
            (~closed & F.col("value").rlike("^[01]\r\n")).alias("open"),
            # A piece may begin inside a line, which its first characters do not name.
            F.concat(F.lit(_MARK), split[0]).alias("_lead"),
            "value",
        )
        .withColumn("content", _field("_lead", "Content-Length").try_cast("long"))
        .drop("_lead")
    )


_PLACED = ("file", "block", "place", "len", "closed", "lead", "open", "content")


def _whole_headers(placed: DataFrame, before: Window) -> DataFrame:
    """`placed` with `head_bytes` and `content` of headers that go on in later pieces.

    Pieces up to a blank line form a group, which may cross blocks; a header that opens in
    one ends at its end.
    """
    ends = F.col("closed").cast("long")
    blocks = placed.groupBy("file", "block").agg(F.sum(ends).alias("_ends"))
    blocks = blocks.withColumn("_earlier", F.coalesce(F.sum("_ends").over(before), F.lit(0))).drop("_ends")
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    from_end = (
        Window.partitionBy("file", "_group").orderBy(F.desc("block"), F.desc("place"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = F.col("closed") | F.col("open") & F.max("closed").over(from_end)
    return (
        placed.join(blocks, ["file", "block"])
        .withColumn("_group", F.col("_earlier") + F.coalesce(F.sum(ends).over(inside), F.lit(0)))
        .withColumn("_bytes", F.sum(F.col("lead") + len(_MARK)).over(from_end) - len(_MARK) + 4)
        .withColumn("_content", F.last("content", ignorenulls=True).over(from_end))
        .withColumn("head_bytes", F.when(known, F.col("_bytes")))
        .withColumn("content", F.when(F.col("open"), F.col("_content")).otherwise(F.col("content")))
        .drop("_earlier", "_group", "_bytes", "_content")
    )


def offsets(pieces: DataFrame) -> DataFrame:
    """(file, block, place, offset, succ): candidate marks with their successor offsets.

    Lengths are added up inside blocks and over the blocks of a file.
    """
    size = F.col("len") + len(_MARK)
    narrow = pieces.select(*_PLACED)
    blocks = narrow.groupBy("file", "block").agg(F.sum(size).alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).drop("_bytes")
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    if narrow.where("open").isEmpty():
        headed = narrow.withColumn("head_bytes", F.when(F.col("closed"), F.col("lead") + 4))
    else:
        headed = _whole_headers(narrow, before)
    return (
        headed.join(blocks, ["file", "block"])
        .withColumn("_start", start)
        .select(
            "file",
            "block",
            "place",
            (F.col("_start") - len(_MARK)).alias("offset"),
            F.when(F.col("content") >= 0, F.col("_start") + F.col("head_bytes") + F.col("content") + 4).alias("succ"),
        )
    )


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a block, where its chain leaves the block."""
    pdf = pdf.sort_values("offset", ascending=False)
    leaves: dict[int, int] = {}
    for at, succ in zip(pdf["offset"], pdf["succ"], strict=True):
        leaves[at] = leaves.get(succ, succ)
    return pd.DataFrame({"file": pdf["file"], "entry": pdf["offset"], "leave": [leaves[x] for x in pdf["offset"]]})


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of a block on the chain from its entry."""
    succ = dict(zip(pdf["offset"], pdf["succ"], strict=True))
    at, found = pdf["entry"].iloc[0], []
    while at in succ:
        found.append(at)
        at = succ[at]
    return pd.DataFrame({"file": pdf["file"].iloc[0], "offset": pd.Series(found, dtype="int64")})


def reachable(marks: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, offset) of the records on the chain from the start of each file."""
    # The first piece of a file precedes every mark, so its offset is negative.
    candidates = marks.where((F.col("offset") >= 0) & F.col("succ").isNotNull() & (F.col("succ") > F.col("offset")))
    hops = candidates.groupBy("file", "block").applyInPandas(_chain, "file string, entry long, leave long")
    widest = marks.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    reach = candidates.where("offset = 0").select("file", F.col("offset").alias("entry"))
    if widest > 1:
        hops, reach = scratch.stage(hops), scratch.stage(reach)
        for _ in range((widest - 1).bit_length()):
            ahead = reach.join(hops, ["file", "entry"]).select("file", F.col("leave").alias("entry"))
            reach = scratch.stage(reach.union(ahead).distinct())
            second = hops.select("file", F.col("entry").alias("leave"), F.col("leave").alias("_next"))
            hops = scratch.stage(hops.join(second, ["file", "leave"]).select("file", "entry", F.col("_next").alias("leave")))
    entries = reach.join(
        candidates.select("file", "block", F.col("offset").alias("entry")), ["file", "entry"]
    ).select("file", "block", "entry")
    return (
        candidates.join(entries, ["file", "block"])
        .groupBy("file", "block")
        .applyInPandas(_follow, "file string, offset long")
    )


_AT = ["file", "block", "place"]


def owned(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, block, place, offset, real, owner): every piece with the record it belongs to."""
    marks = scratch.stage(offsets(pieces))
    real = reachable(marks, scratch).withColumn("real", F.lit(True))
    flagged = scratch.stage(marks.join(real, ["file", "offset"], "left"))
    # Pieces after a false mark belong to the last record before them: in their block,
    # or else in the nearest earlier block that has one.
    lasts = flagged.where("real").groupBy("file", "block").agg(F.max("offset").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        flagged.select("file", "block").distinct()
        .join(lasts, ["file", "block"], "left")
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
        .drop("_last")
    )
    inside = Window.partitionBy("file", "block").orderBy("place")
    own = F.last(F.when(F.col("real"), F.col("offset")), ignorenulls=True).over(inside)
    return scratch.stage(
        flagged.join(carried, ["file", "block"], "left")
        .withColumn("owner", F.coalesce(own, F.col("_carried")))
        .select("file", "block", "place", "offset", "real", "owner")
        .where("owner is not null")
    )


def records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """All records of the archives, whole: file, offset, head, content, body (bytes after the header).

    Files that don't begin with a mark, or whose chain breaks, give the records up to
    there. A folder without files gives no rows.
    """
    pieces = scratch.stage(segments(spark, path))
    places = owned(pieces, scratch)
    cut = places.where("real is null").select("file", "owner").distinct()
    raw = F.col("value").cast("binary")
    whole = (
        places.where("real").join(cut, ["file", "owner"], "left_anti")
        .join(pieces, _AT)
        .select("file", "offset", "head", "content", raw.alias("raw"))
    )
    mended = (
        places.join(cut, ["file", "owner"], "left_semi")
        .join(pieces, _AT)
        .select("file", "owner", "offset", raw.alias("raw"))
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "raw"))).alias("parts"))
        .select(
            "file",
            F.col("owner").alias("offset"),
            F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].raw, (a, p) -> concat(a, binary('{_MARK}'), p.raw))").alias("raw"),
        )
        # The first piece may hold a part of the header only.
        .withColumn("head", F.split(F.col("raw").cast("string"), _EOL * 2, 2)[0])
        .withColumn("content", _field("head", "Content-Length").try_cast("long"))
        .select("file", "offset", "head", "content", "raw")
    )
    return whole.union(mended).select("file", "offset", "head", "content", _after_head("raw").alias("body"))


def _after_head(raw: str) -> Column:
    return F.substring(raw, F.octet_length("head") + F.lit(5), F.col("content").cast("int"))


def _page(body: Column) -> dict[str, Column]:
    """What a record (`head` and its `body`) says of its page."""
    split = F.split(F.decode(body, "ISO-8859-1"), _EOL * 2, 2)
    http = split[0]
    urn = lambda name: F.regexp_extract(_field("head", name), r"urn:page:(-?\d+)", 1).try_cast("long")
    payload = F.substring(body, F.octet_length(http) + F.lit(5), F.lit(2**31 - 1))
    named = F.regexp_extract(_field("head", "WARC-Payload-Digest"), "([0-9a-f]{40})", 1)
    kind = _field("head", "WARC-Type")
    stored = kind != "revisit"
    declared = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    return {
        "page_id": urn("WARC-Record-ID"),
        "payload_bytes": F.when(stored, F.octet_length(payload).cast("long")).otherwise(declared),
        "payload_digest": F.when(stored, F.sha1(payload)).otherwise(named),
        "record_type": kind,
        "refers_to": F.when(~stored, urn("WARC-Refers-To")),
        "intact": ~stored | (F.sha1(payload) == named),
    }


def pages(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of every record.

    `intact` tells whether the payload that is there has the digest its header names.
    Records are described where Spark reads them, and only these few columns move; the
    bytes themselves are put together only where false marks have cut a record.
    """
    body = _after_head("raw")
    names = list(_page(body))
    facts = scratch.stage(
        segments(spark, path).withColumn("raw", F.col("value").cast("binary")).select(
            *_PLACED, "head", *(c.alias(n) for n, c in _page(body).items())
        )
    )
    places = owned(facts, scratch)
    if places.where("real is null").isEmpty():
        return places.where("real").join(facts.select(*_AT, *names), _AT).select(*names)
    found = records(spark, path, scratch)
    return found.select(*(c.alias(n) for n, c in _page(F.col("body")).items()))
