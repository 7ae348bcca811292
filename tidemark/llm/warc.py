"""Merkle fixity audit of archived web records.

Pages become WARC response records, numbered in the order of a content hash and laid into files of FILE_RECORDS
records with byte offsets. A leaf hashes a record's file, offset, length and digest, so that bytes in another place differ as other bytes do;
a node hashes its FANOUT children in order, that is an ordered range of offsets. Two replicas agree where their roots do; where not, only
children of nodes that differ are compared, down to the records. What differs on a level is stored before the next is read, and the
descent ends where nothing does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, numbered, whole_text

FANOUT, FILE_RECORDS = 16, 1024
FETCHED = "2024-01-01T00:00:00Z"


def record(url: str = "url", html: str = "html", page_id: str = "page_id", fetched: str = FETCHED) -> Column:
    """A WARC 1.0 response record with the HTTP response as its block. Null url and html count as empty ones, line ends in a url are
    percent-encoded, and the record's id comes from its content. Pages name no time; all get one date."""
    body = whole_text(html)
    ident = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), whole_text(url), body))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: {fetched}\r\nWARC-Record-ID: <urn:md5:"),
        ident,
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.regexp_replace(whole_text(url), "\r", "%0D"), "\n", "%0A"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(http).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, stage: Stage) -> DataFrame:
    """Places records (columns page_id, key, length, digest): adds ordinal, file and offset. Rows that are alike get places of their own."""
    rows, _ = numbered(records, "key", stage, "ordinal", ("page_id", "digest"))
    rows = rows.withColumn("file", F.expr(f"ordinal div {FILE_RECORDS}"))
    before = F.sum("length").over(Window.partitionBy("file").orderBy("ordinal")) - F.col("length")
    return rows.withColumn("offset", before)


def tree(leaves: DataFrame, count: int, stage: Stage, name: str) -> list[DataFrame]:
    """The levels of a tree over leaves (node, digest), leaves first, up to one root. count: more than the highest node number of any replica."""
    levels = [leaves]
    while count > 1:
        count = -(-count // FANOUT)
        nodes = levels[-1].groupBy(F.expr(f"node div {FANOUT}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("_children"))
        text = F.concat_ws("", F.transform("_children", lambda c: F.concat_ws(":", (c.node % FANOUT).cast("string"), c.digest)))
        levels.append(stage.put(nodes.select("node", F.sha2(text, 256).alias("digest")), f"{name}{len(levels)}"))
    return levels


def differing(one: DataFrame, other: DataFrame, count: int, stage: Stage) -> DataFrame:
    """Leaves (node, digest, other_digest) whose digests differ, found from the roots down. A leaf that one side lacks differs."""
    a, b = tree(one, count, stage, "a"), tree(other, count, stage, "b")
    found = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        right = right.select("node", F.col("digest").alias("other_digest"))
        if found is not None:
            parents = found.select(F.col("node").alias("_parent"))
            left, right = (x.withColumn("_parent", F.expr(f"node div {FANOUT}")).join(parents, "_parent", "left_semi").drop("_parent") for x in (left, right))
        found = stage.put(left.join(right, "node", "full").where(~F.col("digest").eqNullSafe(F.col("other_digest"))), "found")
        if found.isEmpty():
            break
    return found


def leaf(file: str, offset: str, length: str, digest: str) -> Column:
    """The hash of a record in its place; null for a record that is not there."""
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in (file, offset, length)], F.col(digest))
    return F.when(F.col(digest).isNotNull(), F.sha2(place, 256)).alias("digest")


def audit(archive: DataFrame, replica: DataFrame, stage: Stage) -> DataFrame:
    """The records of an archive (ordinal, file, offset, length, page_id, digest) that are not the same bytes in the same place in a replica
    (ordinal, found_file, found_offset, found_length, found_digest): both with damage, that is missing, shorter, longer, altered, or moved if
    only the place differs.

    Records that only the replica has come with null places and damage `extra`. An empty archive against an empty replica gives no rows.
    """
    top = archive.agg(F.max("ordinal")).union(replica.agg(F.max("ordinal"))).agg(F.max("max(ordinal)")).first()[0]
    one = archive.select(F.col("ordinal").alias("node"), leaf("file", "offset", "length", "digest"))
    other = replica.select(F.col("ordinal").alias("node"), leaf("found_file", "found_offset", "found_length", "found_digest"))
    bad = differing(one, other, 0 if top is None else top + 1, stage).select(F.col("node").alias("ordinal"))
    out = bad.join(archive.select("ordinal", "file", "offset", "length", "page_id", "digest"), "ordinal", "left")
    out = out.join(replica.select("ordinal", "found_file", "found_offset", "found_length", "found_digest"), "ordinal", "left")
    length = F.coalesce("found_length", F.lit(0))
    damage = (
        F.when(F.col("digest").isNull(), "extra").when(length == 0, "missing").when(length < F.col("length"), "shorter").when(length > F.col("length"), "longer")
        .when(F.col("digest") != F.col("found_digest"), "altered").otherwise("moved")
    )
    return out.select("ordinal", "file", "offset", "length", "page_id", "digest", "found_offset", "found_digest", damage.alias("damage"))


def damaged(body: Column, page_id: str = "page_id") -> Column:
    """What a second replica holds of a record in the query's planted faults: of every 211 page ids one has a byte altered, one is cut short, one is
    missing. A fourth stands GAP bytes further on, which misplaced() says."""
    kind = F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(211))
    altered = F.concat(F.substring(body, 1, 39), F.lit("#"), F.expr("substring(_record, 41)"))
    return F.when(kind == 17, altered).when(kind == 59, F.expr("substring(_record, 1, char_length(_record) - 20)")).when(kind == 101, F.lit("")).otherwise(body)


GAP = 512


def misplaced(offset: Column, page_id: str = "page_id") -> Column:
    return offset + F.when(F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(211)) == 151, GAP).otherwise(0)


def page_audit(pages: DataFrame) -> DataFrame:
    """Archives all pages, takes the second replica with its planted faults and its own manifest of places, and audits it.

    Null ids, urls and texts count as empty ones, repeated pages are records of their own, columns beside the three are not read, and an empty
    table has nothing to report.
    """
    stage = Stage(pages.sparkSession, "warc")
    rows = pages.select("page_id", record().alias("_record")).withColumn("_found", damaged(F.col("_record")))
    rows = rows.select(
        "page_id",
        F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.md5("_record"))).alias("key"),
        F.octet_length("_record").cast("long").alias("length"),
        F.sha2("_record", 256).alias("digest"),
        F.octet_length("_found").cast("long").alias("found_length"),
        F.sha2("_found", 256).alias("found_digest"),
    )
    placed = stage.put(manifest(stage.put(rows, "records"), stage), "manifest")
    replica = placed.select("ordinal", F.col("file").alias("found_file"), misplaced(F.col("offset")).alias("found_offset"), "found_length", "found_digest")
    return audit(placed.drop("found_length", "found_digest"), replica, stage)


AUDIT_SQL = f"""
WITH h AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS http FROM pages),
r AS (
  SELECT page_id, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Date: {FETCHED}' || nl || 'WARC-Record-ID: <urn:md5:'
    || md5(coalesce(page_id::VARCHAR, '') || '|' || url || '|' || html) || '>' || nl
    || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl || 'Content-Type: application/http;msgtype=response' || nl
    || 'Content-Length: ' || strlen(http)::VARCHAR || nl || nl || http || nl || nl AS record FROM h),
f AS (
  SELECT *, CASE coalesce(page_id, 0) % 211 WHEN 17 THEN substr(record, 1, 39) || '#' || substr(record, 41)
    WHEN 59 THEN substr(record, 1, length(record) - 20) WHEN 101 THEN '' ELSE record END AS found,
    CASE coalesce(page_id, 0) % 211 WHEN 151 THEN {GAP} ELSE 0 END AS gap FROM r),
n AS (
  SELECT *, strlen(record) AS length, row_number() OVER (ORDER BY md5(coalesce(page_id::VARCHAR, '') || ':' || md5(record)), page_id) - 1 AS ordinal FROM f),
p AS (
  SELECT *, ordinal // {FILE_RECORDS} AS file, (sum(length) OVER (PARTITION BY ordinal // {FILE_RECORDS} ORDER BY ordinal) - length)::BIGINT AS "offset" FROM n)
SELECT ordinal, file, "offset", length, page_id, sha256(record) AS digest, "offset" + gap AS found_offset, sha256(found) AS found_digest,
  CASE WHEN found = '' THEN 'missing' WHEN strlen(found) < length THEN 'shorter' WHEN record <> found THEN 'altered' ELSE 'moved' END AS damage
FROM p WHERE record <> found OR gap <> 0
"""
