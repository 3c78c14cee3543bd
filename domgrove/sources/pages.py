"""Pages in: tables and folders of HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many repeated ids are broadcast as they are (some 200 kB).
FEW_IDS = 10_000
#: Bits of the map that stands in for more of them: 32 MB, whatever their number.
MOST_BITS = 1 << 28
#: Bits of one row of the map, as Spark's bitmap functions have them.
ROW_BITS = 32768


def split_pages(pages: DataFrame, check_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages that can be worked on, and (page_id, url, reason) of those that cannot.

    Of pages that can be worked on but share a page_id all are rejected, because their trees would
    be mixed. For that the ids, no other column, are read and counted here, in a job of their own;
    see `without_repeated`. For tables known to be unique, check_ids=False leaves it out.
    """
    address = F.trim(F.col("url"))
    reason = (
        F.when(F.col("page_id").isNull(), "no page id")
        .when(F.col("url").isNull() | (address == "") | (address == "https://"), "no address")
        .when(F.col("html").isNull(), "no body")
    )
    # Written out, so that the checks for null reach the scan.
    valid = pages.filter(
        F.col("page_id").isNotNull() & F.col("url").isNotNull() & F.col("html").isNotNull()
        & ~address.isin("", "https://")).select("page_id", "url", "html")
    rejects = pages.select("page_id", "url", reason.alias("reason")).filter("reason IS NOT NULL")
    if check_ids:
        valid, repeated = without_repeated(valid, pages)
        if repeated is not None:
            rejects = rejects.unionByName(repeated.select("page_id", "url", F.lit("repeated page id").alias("reason")))
    return valid, rejects


def without_repeated(valid: DataFrame, pages: DataFrame, few: int = FEW_IDS, most_bits: int = MOST_BITS
                     ) -> tuple[DataFrame, DataFrame | None]:
    """The rows of `valid`, a part of `pages`, whose page_id no other of them has, and the others
    (None if no row shares its id).

    Ids that several rows of `pages` have are suspects, of which one look at the id column tells;
    usually there are none, and nothing more is done. Up to `few` of them are broadcast, so pages
    stay where they are and only suspects are counted among the valid rows. More of them are
    broadcast as a map of hashed bits, of at most most_bits: pages that it lets through stay where
    they are as well, and only those that it holds back are moved and compared exactly.
    """
    spark = pages.sparkSession
    suspects = repeated_ids(pages.select("page_id").filter("page_id IS NOT NULL")).select("page_id")
    found = suspects.limit(few + 1).collect()
    if not found:
        return valid, None
    if len(found) <= few:
        ids = F.broadcast(spark.createDataFrame(found, suspects.schema))
        repeated = F.broadcast(repeated_ids(valid.join(ids, "page_id", "left_semi")).select("page_id"))
        return valid.join(repeated, "page_id", "left_anti"), valid.join(repeated, "page_id", "left_semi")
    sifted = sift(valid, "page_id", suspects, most_bits)
    held = sifted.filter("is_suspect").drop("is_suspect")
    repeated = repeated_ids(held).select("page_id")
    alone = held.join(repeated, "page_id", "left_anti")
    return (sifted.filter("NOT is_suspect").drop("is_suspect").unionByName(alone),
            held.join(repeated, "page_id", "left_semi"))


def split_by_ids(rows: DataFrame, ids: DataFrame, few: int = FEW_IDS) -> tuple[DataFrame, DataFrame]:
    """rows (with page_id) that are not among `ids` (page_id, distinct), and those that are.

    Up to `few` ids are broadcast; for more, rows are sifted first, so that nearly all that are not
    among them stay where they are.
    """
    found = ids.limit(few + 1).collect()
    if len(found) <= few:
        known = F.broadcast(rows.sparkSession.createDataFrame(found, ids.schema))
        return rows.join(known, "page_id", "left_anti"), rows.join(known, "page_id", "left_semi")
    sifted = sift(rows, "page_id", ids)
    held = sifted.filter("is_suspect").drop("is_suspect")
    return (sifted.filter("NOT is_suspect").drop("is_suspect").unionByName(held.join(ids, "page_id", "left_anti")),
            held.join(ids, "page_id", "left_semi"))


def sift(rows: DataFrame, key: str, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """rows with is_suspect: true where `key` is among `ids` (one column), false for nearly all others.

    Each id sets one of 16 bits for each id, most_bits at most; tasks combine their bits before the
    map is put together and broadcast. Rows are looked up where they are.
    """
    n = max(1, ids.count())
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * n - 1).bit_length()))

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))

    maps = (ids.select(place(ids.columns[0]).alias("bit")).groupBy(F.expr(f"bit div {ROW_BITS}").alias("row"))
            .agg(F.bitmap_construct_agg(F.expr(f"bit % {ROW_BITS}")).alias("map")))
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own"), place(key).alias("bit"))
    joined = whole.join(F.broadcast(maps), F.expr(f"bit div {ROW_BITS} = row"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(map, cast(bit % {ROW_BITS} div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.expr("cast(bit % 8 AS int)")).bitwiseAND(F.lit(1)) == 1
    return joined.select("own.*", F.coalesce(hit, F.lit(False)).alias("is_suspect"))


def read_pages(spark: SparkSession, path: str, format: str = "parquet", check_ids: bool = True
               ) -> tuple[DataFrame, DataFrame]:
    """Read a table of page_id, url, html; returns pages and rejects."""
    return split_pages(spark.read.format(format).load(path).select("page_id", "url", "html"), check_ids)


def read_html_files(spark: SparkSession, path: str, first_id=lambda address: F.xxhash64(address)) -> DataFrame:
    """HTML files as pages: the address is the file, the id a 64-bit hash of the address.

    Where addresses collide, all but the first in order get the hash of the address and a number, the
    least that gives an id no other file has; so ids differ, and are the same in every run over the
    same files. Files are listed for that, not read.
    """
    address = F.input_file_name()
    files = spark.read.text(path, wholetext=True)
    pages = files.select(first_id(address).alias("page_id"), address.alias("url"), F.col("value").alias("html"))
    # Of this format no content is read as long as nobody asks for it.
    listed = (spark.read.format("binaryFile").load(path).select(address.alias("url"))
              .withColumn("id", first_id(F.col("url"))))
    moved = _moved_ids(spark, listed)
    if not moved:
        return pages
    # Collisions of 64 bits: some tens in 30 billion files.
    other = F.broadcast(spark.createDataFrame(sorted(moved.items()), "url string, moved_id long"))
    return pages.join(other, "url", "left").select(F.coalesce("moved_id", "page_id").alias("page_id"), "url", "html")


def _moved_ids(spark: SparkSession, listed: DataFrame) -> dict[str, int]:
    """Ids of addresses (url, id) other than the first of those that share an id."""
    shared = listed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    rows = listed.join(shared, "id").select("id", "url").collect()
    later = sorted(r["url"] for r in rows)
    for first in {min(r["url"] for r in rows if r["id"] == i) for i in {r["id"] for r in rows}}:
        later.remove(first)
    moved: dict[str, int] = {}
    number = 0
    while later:
        number += 1
        tried = {r["url"]: r["id"] for r in spark.createDataFrame([(u,) for u in later], "url string").select(
            "url", F.xxhash64("url", F.lit(number)).alias("id")).collect()}
        asked = F.broadcast(spark.createDataFrame([(i,) for i in set(tried.values())], "id long"))
        taken = {r["id"] for r in listed.join(asked, "id", "left_semi").select("id").collect()} | set(moved.values())
        for url in list(later):
            if tried[url] not in taken:
                moved[url] = tried[url]
                taken.add(tried[url])
                later.remove(url)
    return moved


def repeated_ids(pages: DataFrame) -> DataFrame:
    """Page ids that are not unique, with their number of rows. Counted before the shuffle."""
    return (pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .filter("n_rows > 1"))
