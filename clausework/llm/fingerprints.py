"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of neighbouring words, weighted by how often they occur; each votes on the signed bits of two 64-bit
hashes. Fingerprints within a Hamming radius are found by permuted block tables: the bits are cut into more blocks than
the radius; two near fingerprints agree in enough blocks, so each choice of that many blocks is a key, one table for
each choice. Equal fingerprints are one entry of the tables, with the number of documents behind it.

Defined results: a null text is empty; a text without words has the fingerprint 0; rows that repeat an id are ordered by
a hash of their text and each have their row; a null id sorts last; with one row, it is its own next document; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import votes
from .common import stored

#: 64-bit planes of a fingerprint.
PLANES = [lambda t: t, lambda t: F.xxhash64(t)]
#: Quantiles of the ids, rows in a cell, cells in a run, and cells up to which their heads are broadcast (24 bytes each).
QUANTILES, CELL_ROWS, RUN, BROADCAST_CELLS = 64, 2_000, 1_000, 200_000
#: The search of the query: the radius in bits, the blocks of a permuted table, and of which ids the rows ask.
RADIUS, BLOCKS, ASKED = 3, 5, 50


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys, which must be unique, and the fingerprint of the text: 32 hexadecimal digits."""
    df = votes.segments(df.select(*keys, votes.words(F.col(text)).alias("words")), "words", 1)
    pairs = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1))), 1, votes.SEGMENT)
    return votes.tally(df, keys, pairs, PLANES)


def _cells(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with a cell: cells are ranges of ids in ascending order, each of about CELL_ROWS rows."""
    n, *_ = row = docs.agg(F.count("*"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()
    at = sorted(set(row[1] or [0]))
    per = max(1, -(-n // (CELL_ROWS * max(1, len(at) - 1))))
    low = at[:-1] or at
    span = [max(1, b - a) for a, b in zip(at, at[1:], strict=False)] or [1]

    def place(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < low[mid], place(lo, mid)).otherwise(place(mid, hi))

    docs = docs.withColumn("range", place(0, len(low)))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("range") + 1)
    inside = F.floor((F.col("doc_id").cast("double") - pick(low)) / pick(span) * per).cast("long")
    cell = F.col("range").cast("long") * per + F.greatest(F.lit(0), F.least(F.lit(per - 1), inside))
    return docs.withColumn("cell", F.when(F.col("doc_id").isNull(), -1).otherwise(cell)).drop("range"), len(low) * per


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in descending order of doc_id within cells: cell, place, doc_id, text, next_text, and ghost.

    A cell ends with a ghost, the first row of the next cell, so that a window over the cell sees each row's next one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    docs, n = _cells(docs)
    head = docs.groupBy("cell").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    # each cell's successor: in its run of cells; of a run's last cell, the first one of the next run that has any
    head = stored(head.withColumn("run", F.floor(F.col("cell") / RUN)), "fingerprint-heads")
    down = Window.orderBy(F.desc("run"))  # a row for each run
    runs = head.groupBy("run").agg(F.max(F.struct("cell", "head")).alias("top"))
    runs = runs.select("run", F.coalesce(F.lead("top.head").over(down), F.first("top.head").over(down)).alias("beyond"))
    inside = Window.partitionBy("run").orderBy(F.desc("cell"))
    follow = head.join(runs, "run").select("cell", F.coalesce(F.lead("head").over(inside), "beyond").alias("next"))
    follow = follow.select(F.col("cell").alias("of"), F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))
    follow = F.broadcast(follow) if n <= BROADCAST_CELLS else follow
    ghosts = docs.join(follow, docs["doc_id"].eqNullSafe(F.col("next_id")) & (docs["tie"] == F.col("next_tie"))).dropDuplicates(["of"])
    both = docs.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", "tie", F.col("of").alias("cell"), F.lit(True).alias("ghost")))
    order = Window.partitionBy("cell").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return both.select("cell", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "ghost")


def edited(n_chars: Column, text: Column, next_text: Column) -> Column:
    """text with its last third replaced by as much of the next text's beginning."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - third), F.substring(next_text, F.lit(1), third))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near: for rows whose id ASKED divides, how many other fingerprints of documents the block tables find within RADIUS bits; null for other rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited(F.col("n_chars"), F.col("text"), F.col("next_text"))))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("next_text")
    keys = ["cell", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    which = F.array(F.struct(F.lit(False).alias("new"), F.col("text").alias("body")), F.struct(F.lit(True).alias("new"), F.col("edited").alias("body")))
    texts = rows.select(*keys, F.explode(F.filter(which, lambda x: ~x["new"] | x["body"].isNotNull())).alias("x")).select(*keys, "x.new", "x.body")
    prints = fingerprints(texts, [*keys, "new"], "body")
    prints = prints.groupBy(*keys).agg(F.max(F.when(~F.col("new"), F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("new"), F.col("fingerprint"))).alias("edited_fingerprint"))
    follow = F.lead("fingerprint").over(Window.partitionBy("cell").orderBy("place"))
    prints = prints.withColumn("next", follow).filter(~F.col("ghost"))
    like = lambda a, b: F.lit(1.0) - votes.differing(F.col(a), F.col(b), len(PLANES)) / F.lit(64.0 * len(PLANES))
    prints = stored(prints.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next").alias("near_next")), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % ASKED == 0, F.lit(False))
    found = near(prints, prints.filter(asks), RADIUS, BLOCKS).filter("distance > 0").groupBy("query").agg(F.count("*").alias("n"))
    some = prints.filter(asks).join(found.hint("merge"), F.col("fingerprint") == F.col("query"), "left").select(*prints.columns, F.coalesce("n", F.lit(0)).alias("n_near"))
    return prints.filter(~asks).withColumn("n_near", F.lit(None).cast("long")).unionByName(some)


def _words(prints: DataFrame) -> DataFrame:
    """The distinct fingerprints as 64-bit words w0, w1, ..."""
    return prints.select(*(votes.as_long(F.substring("fingerprint", 16 * k + 1, 16)).alias(f"w{k}") for k in range(len(PLANES)))).distinct()


def _digits(names: list[str]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names)))


def tables(words: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Distinct fingerprints with a row for each permuted table: key (a hash of the table and the blocks that must agree), and the words."""
    bits, names = 64 * len(PLANES), words.columns
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]

    def masked(chosen: tuple[int, ...], k: int) -> Column:
        """The word's bits that belong to the chosen blocks."""
        keep = sum(1 << (b % 64) for i in chosen for b in range(edges[i], edges[i + 1]) if b // 64 == k)
        return F.col(names[k]).bitwiseAND(F.lit(keep - (1 << 64) if keep >> 63 else keep))

    keys = [F.xxhash64(F.lit(t), *(masked(chosen, k) for k in range(len(names)))) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return words.select(*names, F.explode(F.array(*keys)).alias("key"))


def near(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (query, fingerprint, distance) of a distinct query fingerprint and a distinct one of prints within the radius.

    Both have a column fingerprint. A pair that meets in several tables comes once; both sides are dealt out by the tables' keys,
    a common key's rows by parts of them.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    every, asked = _words(prints), _words(queries)
    names, theirs = every.columns, [f"q{k}" for k in range(len(every.columns))]
    asked = tables(asked, radius, blocks).toDF(*theirs, "key")
    distance = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(w))) for q, w in zip(theirs[1:], names[1:], strict=True)), F.bit_count(F.col(theirs[0]).bitwiseXOR(F.col(names[0]))))
    pairs = tables(every, radius, blocks).join(asked.hint("merge"), "key").select(*theirs, *names, distance.alias("distance")).filter(F.col("distance") <= radius).distinct()
    return pairs.select(_digits(theirs).alias("query"), _digits(names).alias("fingerprint"), "distance")
