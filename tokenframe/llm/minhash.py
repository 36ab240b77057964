"""One-permutation MinHash fingerprints, all in DataFrame functions.

A text's five-word shingles are hashed once. The hash's top bits choose one of 128 bins, and each
bin keeps its least hash. An empty bin takes the value of the first filled bin in a probe order of
its own (optimal densification: bins probe independently, so values aren't passed along in runs).
The low eight bits of each bin are packed. Two fingerprints' share of equal bins exceeds their
likeness J by chance matches, (1 - J) / 256, which is taken off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

BINS, SHIFT, BITS, SHINGLE, PROBES = 128, 56, 8, 5, 16
LOW = (1 << SHIFT) - 1
SPACE = " \t\n\x0b\x0c\r"
ONES = 0x0101010101010101


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for each row."""
    return F.transform(F.array(value), f).getItem(0)


def shingle_hashes(text: Column) -> Column:
    """XXH64 of each run of five words; a text of fewer words is one shingle."""

    def of(words: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.when(F.size(h) < SHINGLE, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))),
        )

    return let(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), f"[{SPACE}]+"), of)


def fingerprint(text: Column) -> Column:
    """array<bigint> of 16 words that pack 128 bins of eight bits; null counts as empty."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), SHIFT).bitwiseOR(F.lit(LOW)))
    bin_of = lambda x: F.shiftright(x, SHIFT)
    filled = lambda x: x.bitwiseAND(F.lit(LOW)) != LOW
    hashes = F.transform(shingle_hashes(text), lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))
    least = let(F.sort_array(F.concat(hashes, marks)), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))

    def dense(m: Column) -> Column:
        def borrowed(b: Column) -> Column:
            tries = [F.get(m, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            rest = F.transform(m, lambda x, j: F.when(filled(x), F.struct(F.xxhash64(b, j, F.lit("rest")).alias("rank"), x.alias("x"))))
            return F.coalesce(*[let(t, lambda x: F.when(filled(x), x)) for t in tries], F.array_min(rest).getField("x"))

        return F.transform(m, lambda x, b: F.when(filled(x), x).otherwise(borrowed(b)).bitwiseAND(F.lit((1 << BITS) - 1)))

    def pack(d: Column) -> Column:
        per = 64 // BITS

        def word(g: Column) -> Column:
            out = F.get(d, g * per)
            for i in range(1, per):
                out = F.shiftleft(out, BITS).bitwiseOR(F.get(d, g * per + i))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)

    return let(let(least, dense), pack)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness of the shingle sets behind two fingerprints, 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        fold = lambda by: lambda v: v.bitwiseOR(F.shiftrightunsigned(v, by))
        for by in (4, 2, 1):
            z = let(z, fold(by))
        return F.bit_count(z.bitwiseAND(F.lit(ONES)))

    wrong = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda t, x: t + x)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - wrong / F.lit(float(BINS)) - chance) / (1 - chance))


def _sortable(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """Whether an id is there, and a value of the same order that is never null: numbers and strings
    stay as they are, other types are ordered as strings."""
    kind = dict(docs.dtypes)[id_col]
    if kind != "string" and not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        kind = "string"
    return F.col(id_col).isNotNull(), F.coalesce(F.col(id_col).cast(kind), F.lit("0").cast(kind))


def ordered(keys: DataFrame) -> DataFrame:
    """keys, of distinct (has, key, tie), with the struct `before`: the row of greatest key under this
    one's, and for the least of all the greatest.

    A range partitioning on the whole key orders them, so that no group of equal ids is ordered in
    one task; the last row of each partition is broadcast, as many as there are shuffle partitions.
    """
    at = F.struct("has", "key", "tie")
    placed = cut(keys.repartitionByRange("has", "key", "tie").withColumn("part", F.spark_partition_id()))
    parts = Window.partitionBy(F.lit(0)).orderBy("of")  # one row for each partition
    ends = placed.groupBy(F.col("part").alias("of")).agg(F.max(at).alias("last"))
    ends = ends.select("of", F.coalesce(F.lag("last").over(parts), F.max("last").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    own = placed.withColumn("lag", F.lag(at).over(Window.partitionBy("part").orderBy("has", "key", "tie")))
    return own.join(F.broadcast(ends), F.col("part") == F.col("of")).select(*keys.columns, F.coalesce("lag", "edge").alias("before"))


def with_next(docs: DataFrame, id_col: str, text_col: str, fp: Column) -> DataFrame:
    """id, text, fp, next_fp, next_text, copies of each row and its successor in descending id.

    next_text is as much of the next row's text as a third of the own text's length takes; after the last row
    comes the first. Null ids count as least. Rows that repeat an id are ordered by the hash of
    their texts; those that repeat an id and a text are one row here, or two: one that is followed
    by the next text, and `copies` that are followed by their own.

    The order is found on keys alone. Texts are shuffled by their keys once, and the share of
    them that their predecessors need once more.
    """
    has, key = _sortable(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), has.alias("has"), key.alias("key"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    keys = rows.groupBy("has", "key", "tie").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("third"))
    to = ordered(keys).select("before.*", F.struct("has", "key", "tie").alias("to"), "third")
    own = rows.groupBy("has", "key", "tie").agg(F.count("*").alias("n"), F.first(F.struct("id", "text", fp.alias("fp"))).alias("row"))
    # both uses of `own` read the same columns, so that Spark shuffles the texts once
    given = own.where("n > 0").join(to, ["has", "key", "tie"]).select("to.*", F.col("row.fp").alias("next_fp"), F.left("row.text", F.col("third")).alias("next_text"))
    both = own.where("n > 0").join(given, ["has", "key", "tie"]).select("n", "row.*", "next_fp", "next_text")
    follower = F.struct(F.lit(1).cast("long").alias("copies"), "next_fp", "next_text")
    itself = F.struct((F.col("n") - 1).alias("copies"), F.col("fp").alias("next_fp"), F.left("text", F.floor(F.length("text") / 3).cast("int")).alias("next_text"))
    return both.select("id", "text", "fp", F.explode(F.when(F.col("n") > 1, F.array(follower, itself)).otherwise(F.array(follower))).alias("f")).select("id", "text", "fp", "f.*")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (256 hex digits), near_edited, near_next.

    The edited text has the last third of the code points (rounded down) replaced by the first as
    many of the next document's in descending id, or by all where that has fewer. A table of one
    row is its own next document; wordless texts share one fingerprint; null counts as empty. Ids may
    be of any type that orders: rows of null ids come last, and rows that repeat an id are ordered by the hash
    of their texts.
    """
    own = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", "text", fingerprint(F.col("text")))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.length("text") - third), F.col("next_text"))
    own = own.select("id", "fp", "next_fp", "copies", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    own = own.select("id", "n_chars", "fp", "next_fp", "copies", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("efp"))
    own = own.select(
        "id", "n_chars", "edited_sha256", hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")),
    )
    return own.drop("col").withColumnRenamed("id", id_col)
