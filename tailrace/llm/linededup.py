"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

Each line is hashed; a rolling hash over the last WINDOW line hashes puts a chunk's end where its
remainder by DIVISOR is below ENDS. An end depends on the lines just before it alone, so inserted or
dropped lines move no later boundary. What is compared are units of several lines: chunks of that
many, and every chunk with the one behind it. Units that occur in more than one place are candidates
by hash; their bytes are compared (they are grouped by the text itself) before anything is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.llm.common import WORD, checkpointed, partitions

#: Lines under the rolling hash; its base and modulus; the share of ends is ENDS in DIVISOR.
WINDOW, BASE, MODULUS, ENDS, DIVISOR = 2, 1_000_003, 2_147_483_647, 3, 4
#: A unit of fewer lines is never removed.
LEAST_LINES = 2
#: Places of a unit that one task compares; a unit with more is dealt to several by doc_id.
PLACES = 500


def line_hashes(lines: Column) -> Column:
    """A number below 2^32 from each line: the first eight digits of its MD5."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))


def chunk_ends(hashes: Column, window: int = WINDOW, ends: int = ENDS, divisor: int = DIVISOR) -> Column:
    """The numbers (from 1) of the lines that end a chunk, the last line always. Before the first
    line the rolling hash sees zeros."""

    def roll(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            h = F.when(i - back >= 1, F.element_at(hashes, F.greatest(i - back, F.lit(1)))).otherwise(F.lit(0))
            total = (total * BASE + h) % MODULUS
        return total

    n = F.size(hashes)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (roll(i) % divisor < ends))


def in_units(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """docs(text, ...) with lines and units in the place of text: array of (lo, n), the first line's
    number from 1 and the number of lines, of the units that count."""
    rest = [c for c in docs.columns if c != "text"]
    with_lines = docs.select(*rest, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    ends = with_lines.withColumn("hashes", line_hashes(F.col("lines"))).withColumn("ends", chunk_ends(F.col("hashes")))
    before = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(j, F.lit(1))))
    chunks = F.transform("ends", lambda e, j: F.struct((before(j) + 1).alias("lo"), (e - before(j)).alias("n")))
    ends = ends.select(*rest, "lines", chunks.alias("chunks"))
    pairs = F.transform(F.slice("chunks", 1, F.size("chunks") - 1), lambda c, j: F.struct(c["lo"].alias("lo"), (c["n"] + F.element_at("chunks", j + 2)["n"]).alias("n")))
    counts = lambda u: (u["n"] >= least_lines) & F.rlike(unit_text(u), F.lit(WORD))
    return ends.select(*rest, "lines", F.filter(F.concat("chunks", pairs), counts).alias("units"))


def unit_text(unit: Column) -> Column:
    return F.array_join(F.slice("lines", unit["lo"], unit["n"]), "\n")


def line_dedup(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """(doc_id, row, n_lines, n_removed, kept), a row for each row of docs: row is all of it as it was
    but for the text, kept the text that is left.

    A unit of at least `least_lines` lines with something other than white space stays at its first
    place - the smallest doc_id, there the first line - and its lines are removed at every other
    place; in one document a place counts as another only if it lies wholly behind the first. Rows
    that share a doc_id are versions of one document: the unit stays in each version, at its first
    place there. Rows without doc_id come after all others and are treated alike among themselves.
    Null text counts as empty: one line, never removed. Empty table: no rows. Other columns
    are carried along in row, whatever their names.
    """
    last = F.lit((1 << 63) - 1)
    row = F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")
    text = F.col("text").cast("string")
    # rows without doc_id share their place in the order, but are dealt by their text
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("deal"), F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), row)
    # only units that may count leave the row, as hashes
    hashes = checkpointed(in_units(docs.select("deal", "text"), least_lines).select("deal", F.explode(F.transform("units", lambda u: F.xxhash64(unit_text(u)))).alias("hash")))
    # one exchange of the texts; both reads of it below are the same exchange
    rows = in_units(docs.repartition(partitions(docs), "deal"), least_lines)
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.expr(f"1 + n div {PLACES}").alias("parts"))
    # which documents hold a repeated hash, then the texts of those units
    wanted = hashes.distinct().join(repeated, "hash").groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct("hash", "parts"))).alias("wanted"))
    named = F.transform("units", lambda u: F.struct(u["lo"].alias("lo"), u["n"].alias("n"), F.xxhash64(unit_text(u)).alias("hash")))
    places = rows.withColumn("units", named).join(wanted, "deal")
    place = F.explode(F.filter("units", lambda u: F.map_contains_key("wanted", u["hash"])))
    places = places.select("deal", "doc_id", "version", "lines", "wanted", place.alias("u")).select("deal", "doc_id", "version", unit_text(F.col("u")).alias("unit"), F.element_at("wanted", F.col("u.hash")).alias("parts"), F.struct("u.lo", "u.n").alias("spot"))
    places = places.groupBy("deal", "doc_id", "version", "unit").agg(F.sort_array(F.collect_list("spot")).alias("spots"), F.max("parts").alias("parts"))
    places = places.withColumn("part", F.pmod("deal", "parts"))
    # the comparison of bytes: equal texts form a group, whatever their hashes say; the first place of
    # a unit goes to each of the parts that its places are dealt to
    first = places.groupBy("unit").agg(F.min("doc_id").alias("first"), F.max("parts").alias("parts")).select("unit", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    behind = F.filter("spots", lambda x: x["lo"] - F.element_at("spots", 1)["lo"] >= x["n"])
    gone = places.join(first, ["unit", "part"]).select("deal", "doc_id", "version", F.when(F.col("first") < F.col("doc_id"), F.col("spots")).otherwise(behind).alias("spots"))
    gone = gone.where(F.size("spots") > 0).groupBy("deal").agg(F.collect_list(F.struct("doc_id", "version", "spots")).alias("gone"))
    marked = rows.drop("units").join(gone, "deal", "left")
    mine = F.filter("gone", lambda g: (g["doc_id"] == F.col("doc_id")) & (g["version"] == F.col("version")))
    off = F.flatten(F.flatten(F.transform(mine, lambda g: F.transform(g["spots"], lambda x: F.sequence(x["lo"], x["lo"] + x["n"] - 1)))))
    marked = marked.withColumn("stay", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size("lines")), off)))
    kept = F.when(F.col("stay").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at("lines", i)), "\n"))
    return marked.select(
        F.nullif("doc_id", last).alias("doc_id"),
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("stay").isNull(), 0).otherwise(F.size("lines") - F.size("stay")).cast("long").alias("n_removed"),
        kept.alias("kept"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text that is left of each, n_chars after it if there is such a column; rows go
    of which nothing but white space is left where something was removed."""
    found = line_dedup(docs).where((F.col("n_removed") == 0) | F.rlike("kept", F.lit(WORD)))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
