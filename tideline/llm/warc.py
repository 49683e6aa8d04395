"""A content-addressed web archive.

Two tables make an archive.  ``payloads`` stores the bytes of each distinct
payload once, under its SHA-256.  ``headers`` stores the exact header bytes of
every record beside the digest it belongs to.  Joining them on the digest gives
back each record byte for byte: header, empty line, payload, two line ends.

A digest is verified twice: on writing, all payloads under one digest must agree
in length and two further hashes; on reading, the stored bytes are hashed again.
Either failing raises an error rather than returning a wrong record.

Payloads are grouped with partial aggregation, so copies shrink to one row per
task before the shuffle.  Where a digest is shared by many records it is joined
by broadcast: only digest, sizes and id are sent, for at most 4,096 digests.

Defined cases: a null payload is empty; payloads under ``min_revisit`` bytes
never become revisits; repeated rows give repeated records, and rows that share
the smallest id of their payload are all responses; a null id is written as
``null`` and read back as null; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, shared_folder, split_heavy

#: Every record of an archive carries one date, so that writing twice gives the same bytes.
DATE = "2000-01-01T00:00:00Z"
_EOL = "\r\n"
#: Records for which a shared payload is copied once when records are rebuilt.
CROWD = 1000


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _header(record_type: Column, refers_to: Column) -> Column:
    """The header block of a record, without the empty line that ends it."""
    revisit = record_type == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        # A line end inside a URL would end the header line, so it is percent-encoded.
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Payload-Length: "), F.col("length"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("length"))),
    ]
    return F.concat_ws(_EOL, *lines)


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 100) -> None:
    """pages(page_id, url, html) -> folder/payloads and folder/headers."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    check = F.struct(F.col("length"), F.xxhash64("payload").alias("x"), F.crc32("payload").alias("c"))
    blobs = (
        rows.groupBy("digest")
        .agg(
            F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n_records"),
            F.min(check).alias("low"), F.max(check).alias("high"),
        )
        .select(
            "digest", "payload", "first_id", "n_records",
            F.when(F.col("low") == F.col("high"), F.col("low.length")).otherwise(F.raise_error(F.concat(F.lit("two payloads share digest "), "digest"))).cast("long").alias("length"),
        )
    )
    blobs.write.mode("overwrite").parquet(f"{folder}/payloads")

    known = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "length", "first_id", "n_records")
    total = known.agg(F.sum("n_records")).first()[0] or 0
    slim = rows.select("page_id", "url", "digest")
    headers = join_skewed(slim, known, ["digest"], "n_records", total)
    again = (F.col("length") >= min_revisit) & (~F.col("page_id").eqNullSafe(F.col("first_id")))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    headers.select("digest", F.encode(_header(kind, F.col("first_id")), "UTF-8").alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, its fields parsed from the stored header bytes."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    h = spark.read.parquet(f"{folder}/headers")
    h = h.withColumns({"_id": page(_field("WARC-Record-ID")), "_ref": page(_field("WARC-Refers-To"))})
    return h.select(
        F.when(F.col("_id") != "", F.col("_id").cast("long")).alias("page_id"),
        F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        F.when(F.col("_ref") != "", F.col("_ref").cast("long")).alias("refers_to"),
        F.coalesce(_field("WARC-Payload-Length"), _field("Content-Length")).cast("long").alias("length"),
        "header",
    )


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads; one whose bytes do not hash to its name raises an error."""
    p = spark.read.parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return p.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")))


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, payload and ``record``: the bytes of each original record.

    A revisit's record has no block of its own; its payload is that of the record it refers to.
    """
    heads = read_headers(spark, folder)
    eol = F.encode(F.lit(_EOL), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    stored_payloads = verified_payloads(spark, folder)
    # A payload of many records is copied once for each CROWD of them, and they are dealt over the copies; of such payloads
    # only digests and numbers are broadcast, at most 4,096.
    known = spark.read.parquet(f"{folder}/payloads").select("digest", "n_records")
    total = known.agg(F.sum("n_records")).first()[0] or 0
    heavy, _ = split_heavy(known.where(F.col("n_records") > CROWD), "n_records", total)
    heavy = F.broadcast(heavy.select("digest", F.ceil(F.col("n_records") / CROWD).alias("__copies")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("__copies", F.lit(1).cast("long")))
    heads = heads.join(heavy, "digest", "left").withColumn("__salt", salt)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1).cast("long")) - 1))
    bodies = stored_payloads.select("digest", "payload").join(heavy, "digest", "left").select("digest", "payload", copies.alias("__salt"))
    joined = heads.join(bodies.hint("merge"), ["digest", "__salt"])
    return joined.select("page_id", "url", "record_type", "refers_to", "payload", F.concat("header", eol, eol, block, eol, eol).alias("record"))


def op6_warc(pages: DataFrame) -> DataFrame:
    """Writes the archive of all pages, reads it back and returns what the archive says of each."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages.select("page_id", "url", "html"), folder)
    stored = verified_payloads(spark, folder)
    # Hashing happens here, per stored payload; the join below then carries no payload bytes.
    sizes = stored.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "n_records")
    total = sizes.agg(F.sum("n_records")).first()[0] or 0
    out = join_skewed(read_headers(spark, folder).drop("header"), sizes, ["digest"], "n_records", total)
    same = F.when(F.col("length") == F.col("payload_bytes"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("length differs from the stored payload")).cast("long"))
    return out.select("page_id", same.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
