"""Near-duplicate lines by a deletion-neighbourhood join, native: DataFrame functions only.

A line is a sequence of words split at single spaces; the distance is Levenshtein's over
words. A line goes if an earlier line of the corpus (smaller doc_id, then line number) is
equal, or is within one edit and the longer of the two has at least ``LEAST_WORDS`` words.
Lines are judged on the input, so what removed a line may itself be removed.

Each line emits all variants within the bound as hashed keys: itself, itself without each
one word, and that again with the place of the gap. Equal keys join: a line and a line
that lacks one of its words share the first kind, lines that differ in one word share the
second. The hash of a variant is an exclusive or over (word, place), so all variants of a
line cost one pass over its words. What joins is verified on the words, and of all
partners the earliest is kept.

Scale: equal lines are first counted as one. A line can only have a partner if it shares
the first or the last half of its words with another; only such lines (a few in a
hundred) emit variants, which loses none: an edit leaves one half as it was. The least
partner of a key is an aggregate, so a key that a third of all lines share is never
gathered, and no pairs are listed within a key; where rows meet their key's partner, hot
keys are split (see common.with_leads). A line's own words are one sorted run, read twice
whatever their number.

A document is an id with a text; documents come in the order of ids (null first), then of
a hash of the text, so rows without an id, or of one id with different texts, are judged
apart. Rows equal in both are one document written twice: their lines stand at equal
places, which are not earlier than each other. Empty lines (nothing but spaces) are never
judged and stay. A null text has one empty line. Empty tables give empty results; other
columns are not used, and ``cleaned`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import table, whole, with_leads, written

LEAST_WORDS = 5
PLACE = ["id", "th", "line_no"]


def documents(docs: DataFrame) -> DataFrame:
    """row (the whole row), id, th (hash of the text) and lines of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(whole(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))


def lines_of(docs: DataFrame) -> DataFrame:
    """id, th, line_no (from 0), line (trimmed), h and h2 (a 128-bit hash of it) of the
    lines that are not empty."""
    rows = documents(docs).select("id", "th", F.posexplode("lines").alias("line_no", "line")).withColumn("line", F.trim("line"))
    return rows.where("line != ''").withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def gates(line: Column, n: Column) -> list[Column]:
    """Hashes of the halves that a partner must share: of the line's own length and of
    one word more."""
    out = []
    for longest in (n, n + 1):
        half = F.floor(longest / 2).cast("int")
        for sign in (1, -1):
            words = F.call_function("substring_index", line, F.lit(" "), half * sign)
            out.append(F.when(longest >= LEAST_WORDS, F.xxhash64(F.lit(sign), half, words)))
    return out


def variants(texts: DataFrame) -> DataFrame:
    """(key, side, wants, id, th, line_no) for every variant of the lines (id, th, line_no,
    n, line). Whole lines (side 1) are partners of lines less a word (side 2), lines with a
    gap at one place (side 0) of each other."""
    words = texts.select(*PLACE, "n", F.posexplode(F.concat(F.split("line", " "), F.array(F.lit(None).cast("string")))).alias("at", "word"))
    line = Window.partitionBy("th", "line_no").orderBy("at")
    before, upto, all_ = (line.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0, Window.unboundedFollowing))
    none = F.lit(0).cast("long")
    lanes = []
    for salt in (0, 1):
        here, moved = (F.when(F.col("word").isNotNull(), F.xxhash64(F.lit(salt), "word", F.col("at") - k)) for k in (0, 1))
        # What follows is the whole less what came so far.
        after = F.coalesce(F.bit_xor(moved).over(all_), none).bitwiseXOR(F.coalesce(F.bit_xor(moved).over(upto), none))
        lanes.append(F.coalesce(F.bit_xor(here).over(before), none).bitwiseXOR(after))
    rows = words.withColumns({"v": lanes[0], "v2": lanes[1]})
    ends = F.col("word").isNull()
    longer = F.when(ends, F.col("n") + 1).otherwise(F.col("n"))
    gap = F.when(~ends & (F.col("n") >= LEAST_WORDS), F.xxhash64(F.lit("gap"), "n", "at", "v", "v2"))
    left = F.when(longer >= LEAST_WORDS, F.xxhash64(F.lit("left"), longer, "v", "v2"))
    side = F.when(ends, 1).otherwise(2)
    made = F.array(F.struct(gap.alias("key"), F.lit(0).alias("side"), F.lit(0).alias("wants")), F.struct(left.alias("key"), side.alias("side"), (3 - side).alias("wants")))
    return rows.select(F.explode(made).alias("x"), *PLACE).select("x.*", *PLACE).where("key is not null")


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(first == 0, F.greatest(F.size(x), F.size(y))).otherwise(first - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def keepers(lines: DataFrame) -> DataFrame:
    """(h, h2, n_rows, keep) of each distinct line that has company: how often it occurs,
    and the earliest place of a line equal to it or within the bound."""
    full = lines.withColumn("n", n_words(F.col("line")))
    for k, g in enumerate(gates(F.col("line"), F.col("n"))):
        full = full.withColumn(f"g{k}", g)
    place = F.struct(*PLACE)
    distinct = written(full.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n_rows"), *[F.min(f"g{k}").alias(f"g{k}") for k in range(4)]))
    # By one hash of the line alone: should two share it, one line too many is looked at.
    halves = distinct.select("h", F.explode(F.array_distinct(F.array(*[f"g{k}" for k in range(4)]))).alias("g")).where("g is not null")
    shared = halves.groupBy("g").count().where("count > 1").select("g")
    near_ones = written(halves.join(shared, "g", "left_semi").select("h").distinct())
    picked = distinct.join(near_ones, "h", "left_semi").select("h", "h2", *[f"first.{c}" for c in PLACE])
    found = lines.select(*PLACE, "line").alias("l").join(picked.alias("p"), F.expr("l.th = p.th and l.line_no = p.line_no and l.id <=> p.id")).select("l.*", "p.h", "p.h2")
    # A document that is written twice gives its lines twice.
    texts = written(found.dropDuplicates(["h", "h2"]).withColumn("n", n_words(F.col("line"))))
    keys = written(variants(texts))
    # A key has gaps only, or whole lines and lines less a word.
    low = [F.min(F.when(F.col("side") < 2, place)).alias("lead1"), F.min(F.when(F.col("side") == 2, place)).alias("lead2")]
    leads = written(keys.groupBy("key").agg(*low, F.count("*").alias("n_rows")).where("n_rows > 1"))
    pairs = with_leads(keys.drop("side"), leads, ["key"], "n_rows", PLACE).withColumn("lead", F.when(F.col("wants") < 2, F.col("lead1")).otherwise(F.col("lead2")))
    pairs = pairs.where(place > F.col("lead")).select(*PLACE, "lead").distinct().select("lead", F.col("th").alias("t1"), F.col("line_no").alias("k1"), F.col("lead.th").alias("t2"), F.col("lead.line_no").alias("k2"))
    # The first place of a line names it by its text and line number alone.
    own = texts.select(F.col("th").alias("t1"), F.col("line_no").alias("k1"), "h", "h2", F.col("line").alias("a"))
    other = texts.select(F.col("th").alias("t2"), F.col("line_no").alias("k2"), F.col("line").alias("b"))
    near = pairs.join(own, ["t1", "k1"]).join(other, ["t2", "k2"]).where(within_one(F.split("a", " "), F.split("b", " "))).groupBy("h", "h2").agg(F.min("lead").alias("near"))
    out = distinct.join(near, ["h", "h2"], "left").where("n_rows > 1 or near is not null")
    return out.select("h", "h2", "n_rows", F.least("first", F.coalesce("near", "first")).alias("keep"))


def removals(docs: DataFrame) -> DataFrame:
    """row (the whole row), id, lines and removed (line numbers from 0, ascending, null for
    none) of each row of ``docs``."""
    lines = lines_of(docs)
    kept = with_leads(lines.select(*PLACE, "h", "h2"), written(keepers(lines)), ["h", "h2"], "n_rows", PLACE)
    gone = kept.where(F.struct(*PLACE) > F.col("keep")).groupBy("id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    return documents(docs).alias("d").join(gone.alias("g"), F.expr("d.th = g.th and d.id <=> g.id"), "left").select("d.row", "d.id", "d.lines", "g.removed")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, ascending), one row for
    each of ``docs``."""
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = removals(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), removed.alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its removed lines; a document that loses all has an
    empty text."""
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.array_join(F.transform(left, lambda k: F.get(F.col("lines"), k)), "\n")
    out = removals(docs).withColumn("row", F.when(F.col("removed").isNull(), F.col("row")).otherwise(F.col("row").withField("text", text)))
    return out.select("row.*")


def op9_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))
