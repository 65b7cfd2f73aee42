"""HTML listings, downloaded files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: titles of the documents looked for.
TITLE = r"(?i)\bnsq\b|not\s+of\s+standard|not\s+standard\s+quality|spurious"


def strip_tags(c: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"(?U)\s+", " "))


def absolute(link: Column, base: str) -> Column:
    """A link made absolute against a site's address."""
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(link.startswith("/"), "").otherwise("/"), link))


def listed_documents(pages: DataFrame, base: str, marker: str = "download_file_division.jsp") -> DataFrame:
    """(title, release_date, release, size_label, link, page) of a listing's rows whose title is one looked for.

    ``pages`` has (page, html). Only the body of the table counts; the first
    page that lists a link keeps it; newest first. Rows with fewer than three
    cells or without a link are none.
    """
    body = F.when(F.instr("html", "<tbody>") > 0, F.expr("substring(html, instr(html, '<tbody>'))")).otherwise(F.col("html"))
    rows = pages.select("page", F.posexplode(F.regexp_extract_all(body, F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("at", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), strip_tags)
    link = F.regexp_extract("row", rf"href=['\"]([^'\"]*{marker}[^'\"]*)['\"]", 1)
    found = rows.select("page", "at", cells.alias("c"), link.alias("href")).where((F.col("href") != "") & (F.size("c") >= 3) & F.col("c")[1].rlike(TITLE))
    out = found.select(F.col("c")[1].alias("title"), F.col("c")[2].alias("release_date"), F.element_at("c", -1).alias("size_label"), absolute(F.col("href"), base).alias("link"), "page", "at")
    first = out.groupBy("link").agg(F.min(F.struct("page", "at", "title", "release_date", "size_label")).alias("x")).select("x.*", "link")
    return first.withColumn("release", F.expr("to_date(try_to_timestamp(release_date, 'yyyy-MMM-dd'))")).select("title", "release_date", "release", "size_label", "link", "page").orderBy(F.desc_nulls_last("release"), "link")


def document_link(html: Column, base: str) -> Column:
    """The document's own address on its cover page: a frame's source, or a path in a comment."""
    frame, comment = F.regexp_extract(html, r"(?i)src=['\"]([^'\"]+\.pdf)['\"]", 1), F.regexp_extract(html, r"(?i)<!--\s*(/[^>]+?\.pdf)\s*-->", 1)
    hit = F.coalesce(F.nullif(frame, F.lit("")), F.nullif(comment, F.lit("")))
    return F.when(hit.isNotNull(), absolute(F.url_decode(F.replace(F.trim(hit), F.lit("+"), F.lit("%2B"))), base))


def file_name(title: Column, link: Column, release: Column) -> Column:
    """A name for a downloaded document: its date, its title's letters and a mark of its link."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.concat(F.coalesce(F.date_format(release, "yyyy-MM-dd"), F.lit("undated")), F.lit("_"), slug, F.lit("_"), F.substring(F.sha1(link), 1, 6), F.lit(".pdf"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, status) of downloaded files: what doesn't begin as a PDF is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(head, "downloaded").otherwise("not-a-pdf").alias("status"))


def pin_directory(spark: SparkSession, path: str) -> DataFrame:
    """(pincode, statename) of a postal directory; rows with a malformed code or no state are left out."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return directory_rows(raw)


def directory_rows(raw: DataFrame) -> DataFrame:
    """The usable rows of a directory."""
    own = raw.select(F.trim("pincode").alias("pincode"), F.upper(F.trim("statename")).alias("statename"))
    return own.where("pincode RLIKE '^[0-9]{6}$' AND statename <> '' AND statename <> 'NULL'")
