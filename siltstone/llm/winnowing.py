"""Winnowing fingerprints in DataFrame expressions alone.

Every run of `gram` words has a rolling (Karp-Rabin) hash: a polynomial in a base, modulo a prime, over hashes of its words,
of which each is hashed once. The polynomials of all places are rolled on together, from runs of m words to runs of 2m and
m + 1, so a gram takes a few multiplications and never looks at its words again; built-in functions have no running fold
along an array that isn't quadratic in its length. Of each window of `window` consecutive hashes the least is kept, the rightmost of
equal ones, with its position. So two texts that share a run of `window + gram - 1` words share a fingerprint, whatever
surrounds it. A hash and its position are one long, (hash << 31) + (2^31 - 1 - position): the least long of a window is
its least hash, and of equal hashes the rightmost. Minima of windows come by doubling: minima over 1, 2, 4, ... hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, table

GRAM, WINDOW = 5, 8
#: Documents of 2^6 consecutive ids share a block: the unit in which a document meets the next one.
BLOCK_BITS = 6
_LAST, _SPACE = (1 << 31) - 1, r"[\x20\x09-\x0D]+"
#: The largest prime of 32 bits, and a base of 31, so that no product passes a long.
PRIME, BASE = 4294967291, 1640531527
#: A block of more rows than this, and than a 2^-10 share of the table, is split. So 2^10 blocks are split at most.
SPLIT_ROWS, SPLIT_SHARE = 4096, 1 << 10


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, as an array; none of a null or blank one."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def _rolled(one: Column, gram: int) -> Column:
    """The rolling hash of each run of `gram` words, from the hashes `one` of single words."""

    def longer(a: Column, b: Column, by: int, at: int) -> Column:
        """Runs of at + by words from runs a of `at` and runs b of `by` words."""
        n = F.greatest(F.size(b) - at, F.lit(0))
        power = F.lit(pow(BASE, by, PRIME)).cast("long")
        # The power is split in 16 bits and the rest, so that no product passes a long.
        times = lambda x: ((x * F.shiftright(power, 16)) % PRIME * (1 << 16) + x * power.bitwiseAND(F.lit(0xFFFF))) % PRIME
        multiplied = (lambda x: x * BASE) if by == 1 else times
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(at + 1), n), lambda x, y: (multiplied(x) + y) % PRIME)

    def build(rest: str, runs: Column, have: int) -> Column:
        if not rest:
            return runs
        if rest[0] == "0":
            return let(longer(runs, runs, have, have), lambda r: build(rest[1:], r, 2 * have))
        return let(longer(runs, runs, have, have), lambda r: let(longer(r, one, 1, 2 * have), lambda q: build(rest[1:], q, 2 * have + 1)))

    return build(f"{gram:b}"[1:], one, 1)


def gram_hashes(word_array: Column, gram: int = GRAM) -> Column:
    """A packed long for each run of `gram` words; one for all words where they are fewer."""
    packed = lambda x, i: F.shiftleft(x, 31) + (F.lit(_LAST).cast("long") - i)
    whole = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda x, y: (x * BASE + y) % PRIME)
    one = F.transform(word_array, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    return let(one, lambda h: F.transform(F.when(F.size(h) >= gram, _rolled(h, gram)).when(F.size(h) > 0, F.array(whole(h))).otherwise(h), packed))


def window_minima(values: Column, window: int = WINDOW) -> Column:
    """The least of every `window` consecutive values; of all of them where they are fewer."""

    def paired(step: int):
        def least(a: Column) -> Column:
            n = F.size(a) - step
            return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.least(x, y))).otherwise(
                F.when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(a)
            )

        return least

    out, reach = values, 1
    while reach < window:
        step = min(reach, window - reach)
        out, reach = let(out, paired(step)), reach + step
    return out


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint of a text: an array of packed longs, ascending in hash order of their windows, without repeats."""
    return F.array_distinct(window_minima(gram_hashes(words(text), gram), window))


def hashes(prints: Column) -> Column:
    """The distinct 32-bit hashes of a fingerprint."""
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 31)))


def selected(prints: Column) -> Column:
    """A fingerprint as an array of (hash, position); positions count words from 0."""
    return F.transform(prints, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int").alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def digest(prints: Column) -> Column:
    return F.sha2(F.array_join(prints.cast("array<string>"), " "), 256)


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`docs` with its texts' fingerprints, as arrays of (hash, position). A null or blank text has none; an `out` column is replaced."""
    return docs.withColumn(out, selected(fingerprint(F.col(text_col), gram, window)))


def _block_heads(docs: DataFrame) -> DataFrame:
    """(block, first_id, before): each block's least doc_id, and the block before it (before the first: the last)."""
    blocks = in_order(docs.groupBy("block").agg(F.min("doc_id").alias("first_id")), "block")
    own = Window.partitionBy("part").orderBy("block")
    # One row for each partition; a window without keys over them is a few thousand rows at most.
    ends = blocks.groupBy("part").agg(F.max("block").alias("last"))
    over = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(over), F.max("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    return blocks.withColumn("before", F.lag("block").over(own)).join(ends, "part").select("block", "first_id", F.coalesce("before", "last").alias("before"))


def _blocked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark, block) of `docs`: rows of one doc_id are in order of mark, a hash of the text, then of the text.

    A block is (ids, part): 64 ids, or no id, in one part; in parts by doc_id and mark where its rows are many, which only
    rows of one doc_id, or without one, can be.
    """
    ids = F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 60)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ids.alias("ids"))
    counts = docs.groupBy("ids").count()
    n = docs.count()
    many = counts.where(F.col("count") > max(SPLIT_ROWS, n // SPLIT_SHARE))
    bits = F.ceil(F.log2(F.col("count") * 2 / SPLIT_ROWS)).cast("int")
    hot = many.select(F.col("ids").alias("hot_ids"), bits.alias("hot_bits")).collect()  # SPLIT_SHARE rows at most
    docs = docs.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    part = F.lit(0).cast("long")
    if hot:
        split = docs.sparkSession.createDataFrame(hot, "hot_ids long, hot_bits int")
        docs = docs.join(F.broadcast(split), F.col("ids") == F.col("hot_ids"), "left")
        low = F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)), F.lit(0))
        part = F.when(F.col("hot_bits").isNull(), part).otherwise(low * F.expr("shiftleft(1L, hot_bits)") + F.expr("shiftright(mark, 63 - hot_bits)"))
    return docs.select("doc_id", "text", "mark", F.struct("ids", part.alias("part")).alias("block"))


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with block, row (its place in the block), next_text in order of doc_id, and head_text.

    head_text is the text of the next block's first document, on the last row of a block only; after the last document
    comes the first. Rows of equal doc_id follow in order of a hash of their texts, a null doc_id comes first, a null text
    is empty. Blocks are ranges of 64 ids; where many rows share a doc_id, or have none, their texts' hashes split the
    block, so only rows alike in both are never split. Texts move once: only the first documents of blocks move a second
    time. Ids far apart make more blocks, not larger ones. An empty table gives an empty one.
    """
    docs = _blocked(docs)
    # The difference keeps the join's key the block alone, so that this join and the window share one exchange of the texts.
    first = F.coalesce(F.col("doc_id") - F.col("first_id"), F.lit(0)) == 0
    firsts = docs.join(_block_heads(docs.select("doc_id", "block")), "block").where(first)
    heads = firsts.groupBy(F.col("before").alias("head_block")).agg(F.min(F.struct("mark", "text"))["text"].alias("head_text"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "mark", "text")
    placed = docs.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("lead_text"))
    joined = placed.join(heads, (F.col("block") == F.col("head_block")) & F.col("lead_text").isNull(), "left")
    return joined.select("doc_id", "text", "block", "row", F.coalesce("lead_text", "head_text").alias("next_text"), "head_text")


def compare_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next) of each row of `docs` (doc_id, text).

    The edited text has the last quarter of its code points replaced by the first as many of the next document's text.
    Null, empty and blank texts have no prints, and two without prints are alike. Every row counts, repeated ones and null
    ids too, in the order of with_next(); of a single row the next is itself. An empty table gives an empty one; other
    columns are left out.
    """
    rows = with_next(docs)
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.select("doc_id", "block", "row", size.cast("long").alias("n_chars"), "text", edited.alias("edited"), "head_text")
    prints = [fingerprint(F.col(c), gram, window).alias(p) for c, p in (("text", "prints"), ("edited", "edited_prints"))]
    head = F.when(F.col("head_text").isNotNull(), hashes(fingerprint(F.col("head_text"), gram, window)))
    rows = rows.select("doc_id", "block", "row", "n_chars", "edited", *prints, head.alias("head_hashes"))
    rows = rows.select("*", hashes(F.col("prints")).alias("own_hashes"))
    after = F.lead("own_hashes").over(Window.partitionBy("block").orderBy("row"))
    rows = rows.withColumn("next_hashes", F.coalesce(after, "head_hashes"))
    near_edited = likeness(F.col("own_hashes"), hashes(F.col("edited_prints")))
    near_next = likeness(F.col("own_hashes"), F.col("next_hashes"))
    return rows.select("doc_id", "n_chars", "edited", "prints", "edited_prints", near_edited.alias("near_edited"), near_next.alias("near_next"))


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of every row of `documents`, by compare_edits(), which states the odd cases."""
    rows = compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints, edited = digest(F.col("prints")).alias("fingerprint"), digest(F.col("edited_prints")).alias("edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), prints, edited, "near_edited", "near_next")
