"""WARC archives: written with revisits, read back by verifying the chain of record borders.

Reading cuts the files at every occurrence of the magic, wherever tasks find it: each is a candidate record, and its length header
names the offset of its successor.  Only candidates that the start of the file reaches by successors are records; magic inside a
payload is reached by none.  Reachability is found by pointer jumping: links double in length every round, so a file of n records
takes log2(n) rounds at most.  Candidates that follow each other in a split are first taken together as a run; jumping is over runs.

Defined results: a null html counts as empty; payloads under ``least`` bytes are never revisits; rows that repeat a page id are written
as records of their own; of equal payloads the smallest id is the response (every row of it, if the id repeats); an empty table gives
no records; a file that doesn't begin with a record has none, and reading stops where a chain breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf

MAGIC, END, HEADER_END = "WARC/1.1\r\n", "\r\n\r\n", "\r\n\r\n"
LEAST_BYTES = 100


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload another page already has.  Only digests and ids move."""
    html = F.coalesce("html", F.lit(""))
    facts = pages.filter(F.octet_length(html) >= least).select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("payload_digest"))
    first = facts.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return facts.join(first, "payload_digest").filter(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to").distinct()


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(value): the text of one record per page, without the four bytes that end it."""
    again = revisits(pages, least).select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
    again = Shelf(pages.sparkSession).put(again)
    # ids and digests of revisits: 80 bytes a row; beyond the limit Spark joins by shuffle
    small = again.count() <= 200_000
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html")})
    linked = own.join(F.broadcast(again) if small else again, (F.col("page_id") == F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20")  # noqa: E731  a header is one line
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return linked.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", least: int = LEAST_BYTES) -> None:
    """One archive per input split.  Spark's own writer and commit protocol put the files where any Hadoop file system is."""
    records(pages, least).write.options(lineSep=END, compression=compression).mode("overwrite").text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, turn, body): what follows each occurrence of the magic, ``turn`` in the order of the file's split ``block``."""
    cut = spark.read.option("lineSep", MAGIC).text(path)
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"), F.col("value").alias("body"))


def located(cut: DataFrame) -> DataFrame:
    """(file, block, turn, offset, size): where each piece begins.  Sums run within a split, and over the totals of a file's splits."""
    sizes = cut.select("file", "block", "turn", F.octet_length("body").cast("long").alias("size"))
    step = F.col("size") + len(MAGIC)
    blocks = sizes.groupBy("file", "block").agg(F.sum(step).alias("total"))
    before = blocks.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    within = F.sum(step).over(Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - step
    placed = sizes.withColumn("within", within).join(before, ["file", "block"])
    # a piece's magic lies before it; the piece before the first magic begins at minus its length
    return placed.select("file", "block", "turn", (F.col("base") + F.col("within") - len(MAGIC)).alias("offset"), "size")


def header(body: Column, name: str) -> Column:
    """Value of a header line of the record; null if it isn't there."""
    value = F.regexp_extract(F.substring_index(body, HEADER_END, 1), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def reachable(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(file, offset) that offset 0 reaches; ``links`` is (file, block, offset, next)."""
    order = Window.partitionBy("file", "block").orderBy("offset")
    fresh = F.coalesce(F.lag("next").over(order) != F.col("offset"), F.lit(True))
    members = links.select("file", "block", "offset", "next", fresh.alias("fresh"))
    run = F.max(F.when(F.col("fresh"), F.col("offset"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    members = shelf.put(members.select("file", "offset", "next", run.alias("run")))
    # a run leaves by the successor of its last member, which may land anywhere in another run
    exits = members.groupBy("file", "run").agg(F.max("next").alias("exit"))
    landing = members.select("file", F.col("offset").alias("exit"), F.col("run").alias("to"))
    hops = shelf.put(exits.join(landing, ["file", "exit"]).select("file", "run", "exit", "to"))
    reached = shelf.put(members.filter("offset = 0").select("file", "run"))
    jump, count = shelf.put(hops.select("file", "run", "to")), reached.count()
    while True:
        # every link from a reached run, however long by now, ends at a reached one; then links double
        ends = jump.join(reached, ["file", "run"]).select("file", F.col("to").alias("run"))
        more = shelf.put(reached.union(ends).distinct())
        now = more.count()
        if now == count:
            break
        second = jump.select("file", F.col("run").alias("to"), F.col("to").alias("then"))
        longer = shelf.put(jump.join(second, ["file", "to"], "left").select("file", "run", F.coalesce("then", "to").alias("to")))
        shelf.drop(reached, jump)
        reached, jump, count = more, longer, now
    entries = hops.join(more, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("exit").alias("entry"))
    entries = entries.union(members.filter("offset = 0").select("file", "run", "offset")).groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return members.join(entries, ["file", "run"]).filter("offset >= entry").select("file", "offset")


HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "stated_bytes": "X-Payload-Length"}
#: Long payloads are matched with their pieces by file and stretches of so many bytes.
STRETCH = 1 << 20


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``path``, one row each.

    (file, offset, record_type, record_id, refers_to, uri, digest, stated_bytes, length, payload_sha256, payload): type to length as
    the header states them, payload_sha256 of the bytes read (null for a revisit), the payload itself only if asked for.
    """
    shelf = Shelf(spark)
    cut = shelf.put(candidates(spark, path), compression="zstd")
    body = F.col("body")
    whole = body.contains(HEADER_END)
    length = F.when(whole, header(body, "Content-Length").try_cast("long"))
    head = F.octet_length(F.substring_index(body, HEADER_END, 1)) + len(HEADER_END)
    facts = cut.select("file", "block", "turn", body, length.alias("length"), F.when(whole, head).alias("head"))
    raw = F.substring(body.cast("binary"), F.col("head") + 1, F.col("length").cast("int"))
    alone = F.octet_length("body") >= F.col("head") + F.col("length")
    facts = facts.select("file", "block", "turn", "length", "head", alone.alias("alone"), F.when(alone, F.sha2(raw, 256)).alias("own_sha256"), *[header(body, n).alias(c) for c, n in HEADERS.items()])
    end = F.col("offset") + len(MAGIC) + F.col("head") + F.col("length")
    parsed = located(cut).join(facts, ["file", "block", "turn"]).filter("offset >= 0").withColumn("until", end)
    parsed = shelf.put(parsed)
    links = parsed.filter(F.col("until").isNotNull()).select("file", "block", "offset", (F.col("until") + len(END)).alias("next"))
    reached = shelf.put(reachable(links, shelf))
    kept = shelf.put(parsed.join(reached, ["file", "offset"], "left_semi"))
    long = spanning(kept.filter(~F.col("alone")), parsed, cut)
    full = kept.join(long, ["file", "offset"], "left").withColumn("payload_sha256", F.when(F.col("record_type") != "revisit", F.coalesce("own_sha256", F.sha2("long_payload", 256))))
    if payloads:
        full = full.join(cut, ["file", "block", "turn"], "left").withColumn("payload", F.when(F.col("alone"), raw).otherwise(F.col("long_payload")))
    return full.select("file", "offset", *HEADERS, "length", "payload_sha256", *(["payload"] if payloads else []))


def spanning(long: DataFrame, parsed: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, offset, long_payload) of the records whose payload holds magic: their pieces put together again."""
    stretch = lambda c: F.floor(c / STRETCH)
    wanted = long.select("file", F.col("offset").alias("of"), "head", "length", "until", F.explode(F.sequence(stretch(F.col("offset")), stretch(F.col("until")))).alias("stretch"))
    pieces = parsed.select("file", "block", "turn", "offset", stretch(F.col("offset")).alias("stretch"))
    within = wanted.join(pieces, ["file", "stretch"]).filter((F.col("offset") >= F.col("of")) & (F.col("offset") < F.col("until")))
    bodies = within.join(cut, ["file", "block", "turn"]).groupBy("file", "of", "head", "length").agg(F.array_sort(F.collect_list(F.struct("offset", "body"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), MAGIC)
    return bodies.select("file", F.col("of").alias("offset"), F.substring(text.cast("binary"), F.col("head") + 1, F.col("length").cast("int")).alias("long_payload"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or f"{Shelf(spark).root}/archives"
    write(pages, path)
    found = read(spark, path)
    number = lambda c: F.regexp_extract(c, "([-0-9]+)", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("stated_bytes").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("payload_sha256")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number(F.col("refers_to"))).alias("refers_to"),
    )

