"""Document fingerprints: SimHash votes of weighted term hashes, and permuted block tables for a Hamming radius."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower, partitions, saved, scratch, small

#: Range cells between two quantiles at most, rows aimed at in a cell, quantiles taken of the ids, cells aimed at in a task.
MAX_STEPS, CELL_ROWS, QUANTILES, CELLS_A_TASK = 4096, 500, 64, 4
#: Terms are parted by every ASCII character that is no letter or digit.
TERM_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LANES = 0x0000000100000001
#: Bits in which near fingerprints differ at most.
RADIUS = 3


def votes(word: Column) -> list[Column]:
    """Sums of a group's weighted votes: the weight, then for each half 32 sums that hold two bits' votes in 32-bit lanes.

    A term weighs the square of its length, 16 characters at most, so that the short words all texts share count little.
    Lanes hold the votes of 16 million terms of the greatest weight.
    """
    length = F.least(F.length(word), F.lit(16))
    weight = (length * length).cast("long")
    halves = [F.xxhash64(word), F.xxhash64(F.lit("second"), word)]
    sums = [F.sum(F.shiftright(h, j).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}_{j}") for i, h in enumerate(halves) for j in range(32)]
    return [F.sum(weight).alias("w"), *sums]


def half(i: int) -> Column:
    """64 bits: a bit is set where more than half of the weight voted for it."""
    low = [F.when(F.col(f"v{i}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("w"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    high = [F.when(F.shiftrightunsigned(f"v{i}_{j}", 32) * 2 > F.col("w"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0).cast("long")) for j in range(32)]
    both = low + high
    while len(both) > 1:
        both = [a.bitwiseOR(b) for a, b in zip(both[::2], both[1::2])]
    return both[0]


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Bits in which two 128-bit fingerprints differ."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def hex128(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _cells(df: DataFrame) -> tuple[Column, list[tuple]]:
    """A column that deals rows of id and h to range cells of about CELL_ROWS rows, in the order of (id, h), and (first id, its least h, cell) of each cell.

    Ids that are null come first, in cells of their own by ranges of h.
    """
    n, nulls, low, high, cuts = df.agg(F.count("id"), F.count("*") - F.count("id"), F.min("id"), F.max("id"), F.percentile_approx("id", [i / QUANTILES for i in range(1, QUANTILES)], 20_000)).first()
    bounds = sorted({low, *cuts}) if n else []
    ends = [*bounds[1:], high + 1] if n else []
    steps = max(1, min(MAX_STEPS, math.ceil(n / QUANTILES / CELL_ROWS)))
    own = max(1, min(MAX_STEPS, math.ceil(nulls / CELL_ROWS)))
    cell = F.lit(0).cast("long")
    for k, (a, b) in enumerate(zip(bounds, ends)):
        inside = F.floor((F.col("id") - a).cast("double") * steps / float(b - a))
        cell = F.when(F.col("id") >= a, F.least(inside, F.lit(steps - 1)) + k * steps).otherwise(cell)
    by_hash = F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * own), F.lit(own - 1)) - own
    cell = F.when(F.col("id").isNull(), by_hash).otherwise(cell)
    firsts = df.withColumn("cell", cell).groupBy("cell").agg(F.min(F.struct("id", "h")).alias("x")).orderBy("cell").collect()
    return cell, [(r["x"]["id"], r["x"]["h"], r["cell"]) for r in firsts]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is 128 bits, as 32 hex digits: each term of the A-Z lower-cased text (runs without ASCII punctuation or
    white space) votes with its weight on the bits of its hash. Equal texts have equal fingerprints; a text without
    terms has none of the bits. The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next row in ascending id, the first row's after the last; a lone row follows itself. Likeness is the
    share of equal bits. Ids are integers; null ids come first, rows of one id are ordered by a hash of the text. A
    null text is empty; an empty table gives no rows; other columns are ignored.

    Only built-in functions run. Rows are dealt once, by range cells of the id with a bounded number of rows, to a number
    of partitions that grows with the cells, so that long texts of neighbouring ids don't fill one task; each cell also
    gets the next cell's first row, so that `lead` sees across its end. Votes are summed where a cell's rows are, without
    another shuffle. The driver sees quantiles and the first id of each cell, at most (QUANTILES + 1) x MAX_STEPS.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    cell, firsts = _cells(docs.select("id", F.xxhash64("text").alias("h")))
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("cell", cell).withColumn("past", F.lit(False))
    after = [(*firsts[(i + 1) % len(firsts)][:2], cell) for i, (*_, cell) in enumerate(firsts)]
    bridge = spark.createDataFrame(after, f"first {docs.schema['id'].dataType.simpleString()}, first_h long, to long")
    on = rows["id"].eqNullSafe(bridge["first"]) & (rows["h"] == bridge["first_h"])
    across = rows.join(F.broadcast(bridge), on).groupBy("to").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.min("h").alias("h"))
    across = across.select("id", "text", "h", F.col("to").alias("cell"), F.lit(True).alias("past"))
    parts = max(partitions(spark), len(firsts) // CELLS_A_TASK)
    order = Window.partitionBy("cell").orderBy("past", F.col("id").asc_nulls_first(), "h")
    n = F.length("text").cast("long")
    cut = F.expr("CAST(length(text) DIV 2 AS INT)")
    edited = F.concat(F.expr("substring(text, 1, CAST(length(text) - length(text) DIV 2 AS INT))"), F.substring(F.col("next"), F.lit(1), cut))
    pairs = (
        rows.unionByName(across)
        .repartition(parts, "cell")
        .select("cell", "past", "id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
        .withColumn("edited", F.when(~F.col("past"), edited))
        .select("cell", "past", "id", "rn", n.alias("n_chars"), F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.lit("").alias("sha"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("which"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("body")),
        )).alias("x")).where("x.body IS NOT NULL")
        .select("cell", "past", "id", "rn", "n_chars", "x.which", "x.sha", F.explode(F.split(ascii_lower(F.col("x.body")), TERM_SPLIT)).alias("word"))
    )
    keys = ["cell", "rn", "which", "sha"]
    prints = pairs.groupBy(*keys).agg(F.first("id").alias("id"), F.first("past").alias("past"), F.first("n_chars").alias("n_chars"), *votes(F.col("word")))
    prints = prints.select(*keys, "id", "past", "n_chars", half(0).alias("a"), half(1).alias("b"))
    own, new = F.col("which") == 0, F.col("which") == 1
    docs2 = prints.groupBy("cell", "rn").agg(
        F.max("id").alias("id"), F.max("past").alias("past"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        *(F.max(F.when(w, F.col(c))).alias(f"{c}{i}") for i, w in enumerate((own, new)) for c in ("a", "b")),
    )
    line = Window.partitionBy("cell").orderBy("rn")
    out = docs2.select("*", F.lead("a0").over(line).alias("na"), F.lead("b0").over(line).alias("nb")).where(~F.col("past"))
    c = F.col
    return out.select(
        c("id").alias(id_col), "n_chars", "edited_sha256",
        hex128(c("a0"), c("b0")).alias("fingerprint"), hex128(c("a1"), c("b1")).alias("edited_fingerprint"),
        (1 - distance(c("a0"), c("b0"), c("a1"), c("b1")) / 128).alias("near_edited"), (1 - distance(c("a0"), c("b0"), c("na"), c("nb")) / 128).alias("near_next"),
    )


def _fronts(own: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows of a and b (the halves of a fingerprint) once for each table, with t and front: a hash of the blocks that the table permutes to the front."""
    edges = [round(i * 128 / blocks) for i in range(blocks + 1)]
    tables = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        high, low = (x - (1 << 64 if x >> 63 else 0) for x in (mask >> 64, mask & (1 << 64) - 1))
        tables.append(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("a").bitwiseAND(F.lit(high)), F.col("b").bitwiseAND(F.lit(low))).alias("front")))
    return own.withColumn("x", F.explode(F.array(*tables))).select(*own.columns, "x.t", "x.front")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int, blocks: int | None = None, print_col: str = "fingerprint") -> DataFrame:
    """All pairs of distinct fingerprints (query_print, print, distance, n: rows that have print) at most `radius` bits apart.

    The 128 bits are cut into `blocks` (radius + 2 if not given). Two fingerprints that differ in at most `radius` bits agree in all
    but `radius` blocks, so each table permutes another choice of blocks - radius blocks to the front and looks up fingerprints that
    agree there; the others are checked by distance. Copies are counted before they are dealt to the tables, so each fingerprint stands
    there once; fronts that no query has are dropped before they meet. Null fingerprints match nothing; empty tables give no rows.
    """
    k = blocks or radius + 2
    long = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")

    def tabled(df: DataFrame, name: str) -> DataFrame:
        own = df.where(F.col(print_col).isNotNull()).groupBy(F.col(print_col).alias(name)).agg(F.count("*").alias("n"))
        return own.select(name, "n", long(F.col(name), 0).alias("a"), long(F.col(name), 1).alias("b"))

    asked, all_ = _fronts(tabled(queries, "query_print").drop("n"), radius, k), _fronts(tabled(prints, "print"), radius, k)
    asked = asked.select("query_print", F.col("a").alias("qa"), F.col("b").alias("qb"), "t", "front")
    met = asked.join(all_, ["t", "front"]).withColumn("distance", distance(F.col("qa"), F.col("qb"), F.col("a"), F.col("b"))).where(F.col("distance") <= radius)
    return met.groupBy("query_print", "print").agg(F.max("distance").cast("int").alias("distance"), F.max("n").alias("n"))


def near_counts(prints: DataFrame, every: int = 20, radius: int = RADIUS, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """prints with n_within: for rows whose id is divisible by `every`, how many rows have a fingerprint at most `radius` bits away, the row itself among them; else null.

    Each distinct fingerprint of those rows is searched once among all distinct fingerprints, and its count goes to all its rows.
    """
    asks = F.col(id_col) % every == 0
    with scratch() as keep:
        found = within_radius(prints.where(asks).select(print_col), prints.select(print_col), radius, print_col=print_col)
        keep(counts := saved(found.groupBy(F.col("query_print").alias("__print")).agg(F.sum("n").alias("n_within")), "near-counts"))
    return prints.join(small(counts), asks & (prints[print_col] == counts["__print"]), "left").select(*(prints[c] for c in prints.columns), "n_within")
