"""Which texts hold which: small documents are searched whole, larger ones by an index of grams and places, so that no row ever carries more than DIRECT characters of a document.

For the index texts are cut into blocks, each with the block behind it. Of any WINDOW neighbouring grams of a block the one of the least hash is
posted with its place. A pattern has at least one whole window, whose least gram must be posted wherever a text holds the pattern; it
meets the places of its rarest such gram by an equi-join, and its own blocks are compared with the text's there. Shorter patterns are
looked up among the grams of their own length. A row is as wide as a block, whatever the texts' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written

#: Characters of a block and of a gram, grams in a window, characters of a pattern in which its gram is sought.
BLOCK, GRAM, WINDOW, SEED = 256, 4, 5, 64
#: Characters of a key's texts up to which they are searched as they are.
DIRECT = 1 << 18
#: Characters from which a pattern has a whole window.
LEAST = GRAM + WINDOW - 1


def named(norm: Column) -> Column:
    """A text's name in joins."""
    return F.md5(norm)


def _pieces(text: Column, first: Column) -> Column:
    """A text cut into a piece of `first` characters and pieces of BLOCK."""
    return F.when(F.length(text) <= first, F.array(text)).otherwise(F.concat(F.array(F.left(text, first)), F.regexp_extract_all(F.substring(text, first + 1, F.length(text)), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))


def _blocks(texts: DataFrame, key: str) -> DataFrame:
    """key, tid, block, n (its characters), text (its own and the next block's) of texts (key, tid, start, text) that stand one behind the other."""
    rows = texts.filter(F.length("text") > 0).withColumn("inside", (F.col("start") % BLOCK).cast("int"))
    rows = rows.select(key, "tid", (F.col("start") / BLOCK).cast("long").alias("from"), "inside", F.posexplode(_pieces(F.col("text"), BLOCK - F.col("inside"))).alias("k", "piece"))
    block, place = F.col("from") + F.col("k"), F.when(F.col("k") == 0, F.col("inside")).otherwise(0)
    twice = F.explode(F.array(F.struct(block.alias("block"), place.alias("place")), F.struct((block - 1).alias("block"), (place + BLOCK).alias("place"))))
    rows = rows.select(key, "tid", "piece", twice.alias("x")).select(key, "tid", "piece", "x.*").filter("block >= 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(key, "tid", "block").agg(F.sum(F.when(F.col("place") < BLOCK, F.length("piece")).otherwise(0)).cast("int").alias("n"), whole.alias("text")).filter("n > 0")


def _hashes(text: Column) -> Column:
    """The hash of the gram at each place of a text of at least GRAM characters."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.xxhash64(F.substring(text, i, GRAM)))


def _chosen(text: Column, n: Column, edge: bool) -> Column:
    """struct(gram, place) at the first n places of a text that are least in a whole window; edge: what stands in front isn't known, so the first places are chosen too."""

    def pick(h: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda j: F.array_min(F.slice(h, j, F.lit(WINDOW))))

        def of(m: Column) -> Column:
            windows = lambda i: F.slice(m, F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i + 1, F.lit(WINDOW)))
            taken = lambda x, i: (i < n) & ((i < (WINDOW - 1 if edge else 0)) | (F.array_max(windows(i)) == x))
            return F.filter(F.transform(h, lambda x, i: F.struct(x.alias("gram"), i.alias("place"), taken(x, i).alias("taken"))), lambda s: F.coalesce(s["taken"], F.lit(False)))

        return T.let(least, of)

    few = F.transform(F.sequence(F.lit(0), F.length(text) - GRAM), lambda i: F.struct(F.xxhash64(F.substring(text, i + 1, GRAM)).alias("gram"), i.alias("place"), F.lit(True).alias("taken")))
    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("gram"), F.lit(0).alias("place"), F.lit(False).alias("taken"))), lambda s: s["taken"])
    return F.when(F.length(text) >= LEAST, T.let(_hashes(text), pick)).when(F.length(text) >= GRAM, few).otherwise(none)


def find(patterns: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pid, tid of each pattern (key, pid, norm; pid unique within key) and each text of the same key that holds it.

    texts: key, tid, start, text: pieces of the text tid, each from its start on. Empty patterns are held by none, and no text holds a NUL.
    """
    big = large(texts, key)
    if big.isEmpty():
        return _direct(patterns, texts, key)
    return _direct(patterns, texts.join(big, key, "left_anti"), key).unionByName(indexed(patterns.join(big, key, "left_semi"), texts.join(big, key, "left_semi"), key))


def large(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of which texts (key, text) are too much for a row."""
    return written(texts.groupBy(key).agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") > DIRECT).select(key), "large")


def whole_texts(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tid, text: the pieces of each text put together."""
    return texts.groupBy(key, "tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))


def _direct(patterns: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """find() where a key's texts fit in a row: one search in all of them, then in each for what was found."""
    one = whole_texts(texts, key)
    whole = one.groupBy(key).agg(F.array_join(F.collect_list("text"), "\x00").alias("text"))
    some = patterns.filter("norm <> ''").join(whole, key).filter(F.contains("text", "norm")).drop("text")
    return some.join(one, key).filter(F.contains("text", "norm")).select(key, "pid", "tid")


def indexed(patterns: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """find() by the index."""
    blocks = written(_blocks(texts.join(patterns.select(key).distinct(), key, "left_semi"), key), "blocks")
    patterns = patterns.withColumn("size", F.length("norm"))
    long, short = patterns.filter(F.col("size") >= LEAST), patterns.filter((F.col("size") > 0) & (F.col("size") < LEAST))
    # short ones: all grams of their length
    sizes = short.select(key, "size").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("text"), i, F.col("size")))
    there = blocks.join(sizes, key).select(key, "tid", "size", F.explode(F.array_distinct(grams)).alias("norm")).filter(F.length("norm") == F.col("size"))
    small = short.join(there, [key, "norm"]).select(key, "pid", "tid")
    # the others: the places of their rarest gram, then block by block
    posted = blocks.join(long.select(key).distinct(), key, "left_semi").select(key, "tid", "block", F.explode(_chosen(F.col("text"), F.col("n"), True)).alias("c"))
    posted = posted.select(key, "tid", F.col("c.gram").alias("gram"), (F.col("block") * BLOCK + F.col("c.place")).alias("at"))
    head = F.left("norm", F.lit(SEED))
    asked = long.select(key, "pid", F.explode(_chosen(head, F.length(head), False)).alias("c")).select(key, "pid", F.col("c.gram").alias("gram"), F.col("c.place").alias("place"))
    often = posted.groupBy(key, "gram").agg(F.count("*").alias("often"))
    rarest = asked.join(often, [key, "gram"], "left").groupBy(key, "pid").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "place")).alias("r")).filter("r.often > 0")
    places = rarest.select(key, "pid", "r.gram", "r.place").join(posted, [key, "gram"]).select(key, "pid", "tid", (F.col("at") - F.col("place")).alias("at")).filter("at >= 0")
    parts = long.select(key, "pid", "size", F.posexplode(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("k", "part"))
    here = F.col("at") + F.col("k") * BLOCK
    pairs = places.join(parts, [key, "pid"]).select(key, "pid", "tid", "at", "size", "part", (here / BLOCK).cast("long").alias("block"), (here % BLOCK).cast("int").alias("inside"))
    same = pairs.join(blocks, [key, "tid", "block"]).filter(F.substring(F.col("text"), F.col("inside") + 1, F.length("part")) == F.col("part"))
    large = same.groupBy(key, "pid", "tid", "at", "size").agg(F.count("*").alias("n")).filter(F.col("n") == F.ceil(F.col("size") / BLOCK)).select(key, "pid", "tid")
    return small.unionByName(large).distinct()


def joined(rows: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("pos", "norm")) -> DataFrame:
    """rows (key, norm) as one text a key, in order: key, tid, start, text."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, F.lit("").alias("tid"), F.coalesce(F.sum(F.length("norm")).over(before), F.lit(0)).alias("start"), F.col("norm").alias("text"))


def each(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct texts of rows (key, norm), each on its own: key, tid, start, text."""
    return rows.select(key, "norm").distinct().select(key, named(F.col("norm")).alias("tid"), F.lit(0).cast("long").alias("start"), F.col("norm").alias("text"))


def patterns(rows: DataFrame, key: str = "doc_id", least: int = 1) -> DataFrame:
    """The distinct texts of rows (key, norm) as patterns: key, pid, norm."""
    return rows.filter(F.length("norm") >= least).select(key, "norm").distinct().select(key, named(F.col("norm")).alias("pid"), "norm")
