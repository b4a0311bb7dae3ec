"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

Built-in functions only.  A text is split at line ends into paragraphs; a
paragraph into phrases of up to twelve words that end with a sentence; and a run
of paragraphs, closed by one whose hash says so (one in four), is a section.  So
an insertion moves no boundary but those around it.

* leaf: hash of a phrase, 8 hexadecimal digits;
* paragraph: SHA-256 of its raw text;
* section: SHA-256 of its paragraphs' hashes in order;
* root: SHA-256 of the sections' hashes in order.

The fingerprint is one string, ``root;section:paragraph=leaf.leaf,paragraph=...;...``,
with hashes of sections and paragraphs cut to 16 digits.  Equal texts have equal
strings, and roots differ where texts do; where they differ, the hashes of
sections, paragraphs and leaves locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, ranges

#: A phrase: up to twelve words, none after the end of a sentence.
PHRASE = r"\S++(?:(?<![.!?])\s++\S++){0,11}"


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text (null counts as empty)."""
    phrases = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), lambda s: F.right(F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0"), F.lit(8))), ".")

    def paragraph(p: Column) -> Column:
        h = F.sha2(p, 256)
        close = F.substring(h, 64, 1).isin("0", "4", "8", "c")
        return F.concat(F.substring(h, 1, 16), F.lit("="), phrases(p), F.when(close, F.lit(";")).otherwise(F.lit(",")))

    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph)
    # the last paragraph closes its section in any case
    body = F.regexp_replace(F.array_join(paragraphs, ""), "[;,]$", "")
    sections = F.transform(F.split(body, ";"), lambda s: F.concat(F.substring(F.sha2(F.regexp_replace(s, "=[^,]*", ""), 256), 1, 16), F.lit(":"), s))
    tree = F.array_join(sections, ";")
    root = F.sha2(F.regexp_replace(tree, ":[^;]*", ""), 256)
    return F.concat(root, F.lit(";"), tree)


def root(fp: Column) -> Column:
    """The root hash of a fingerprint string."""
    return F.substring(fp, 1, 64)


def _paragraphs(fp: Column) -> Column:
    """The paragraphs of a fingerprint string, each with its leaves."""
    sections = F.split(F.substring(fp, 66, 2147483647), ";")
    return F.flatten(F.transform(sections, lambda s: F.split(F.regexp_replace(s, "^[^:]*:", ""), ",")))


def _leaves(paragraphs: Column) -> Column:
    return F.filter(F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.split(F.substring_index(p, "=", -1), r"\.")))), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct leaves of two fingerprint strings, 0 to 1.

    Equal roots give 1 without looking further; two texts without words are
    alike (1) only if equal, else 0.
    """
    x, y = _leaves(_paragraphs(a)), _leaves(_paragraphs(b))
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y)
    return F.when(root(a) == root(b), F.lit(1.0)).when(total > 0, 2.0 * both / total).otherwise(F.lit(0.0))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of ``a`` that ``b`` lacks; none, without looking, if the roots are equal."""
    hashes = lambda ps: F.transform(ps, lambda p: F.substring_index(p, "=", 1))
    theirs = hashes(_paragraphs(b))
    mine = hashes(_paragraphs(a))
    pos = F.filter(F.transform(mine, lambda p, i: F.when(~F.array_contains(theirs, p), i)), lambda i: i.isNotNull())
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(pos)


def with_next(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` its own text and what it needs of the next document.

    Order: descending ``doc_id``, null last; rows of one id by their text's hash;
    after the last comes the first.  Returns doc_id, text, n_chars, fp, and of
    the next document ``next_half`` (its first floor(n_chars/2) code points) and
    ``next_fp``.

    Only (id, number among rows of that id, length) is sorted over all rows: in
    ranges, with the first row of each range handed to the one before.  Texts
    are shuffled by id once; of each, the half of its neighbour's length and the
    fingerprint travel to that neighbour.
    """
    n = ranges(docs)
    none = F.lit(-(1 << 63))
    # the id is got back from the key, so that both uses of the texts need equal columns and share one shuffle
    t = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    same = Window.partitionBy("k").orderBy(F.col("h"))
    narrow = t.select("k", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n"))
    narrow = narrow.withColumn("r", F.row_number().over(same))
    # the range of a row is written down, so a task that runs again cannot deal it elsewhere
    ranged = materialise(narrow.repartitionByRange(n, F.desc("k"), F.asc("r")).withColumn("pid", F.spark_partition_id()), "order")
    order = Window.partitionBy("pid").orderBy(F.desc("k"), F.asc("r"))
    inner = ranged.select("k", "r", "n", "pid", F.lead("k").over(order).alias("nk"), F.lead("r").over(order).alias("nr"))
    edge = ranged.groupBy("pid").agg(F.min(F.struct((-F.col("k").cast("decimal(20,0)")).alias("o"), "r", "k")).alias("f"))
    # one row per range: as many as partitions, whatever the data
    ring = Window.orderBy("pid")
    heads = edge.select("pid", F.col("f.k").alias("fk"), F.col("f.r").alias("fr"))
    first = heads.agg(F.min_by("fk", "pid").alias("zk"), F.min_by("fr", "pid").alias("zr"))
    heads = heads.select("pid", F.lead("fk").over(ring).alias("lk"), F.lead("fr").over(ring).alias("lr")).crossJoin(F.broadcast(first))
    linked = inner.join(F.broadcast(heads), "pid").select("k", "r", "n", F.coalesce("nk", "lk", "zk").alias("nk"), F.coalesce("nr", "lr", "zr").alias("nr"))

    whole = t.withColumn("h", F.xxhash64("text")).withColumn("r", F.row_number().over(same)).drop("h").withColumn("fp", fingerprint(F.col("text")))
    asks = linked.select(F.col("nk").alias("k"), F.col("nr").alias("ar"), F.col("k").alias("pk"), F.col("r").alias("pr"), F.col("n").alias("pn"))
    sent = whole.join(asks, "k").where("r - ar = 0").select(F.col("pk").alias("k"), F.col("pr").alias("sr"), F.expr("substring(text, 1, int(pn div 2))").alias("next_half"), F.col("fp").alias("next_fp"))
    return whole.join(sent, "k").where("r - sr = 0").select(F.nullif(F.col("k"), none).alias("doc_id"), "text", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_half", "next_fp")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness (see the query's contract).

    The edited text keeps the first ceil(n/2) code points and ends with as many
    of the next document's first ones as were cut, or all it has.
    """
    t = with_next(docs).withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), next_half)"))
    t = t.withColumn("edited_fp", fingerprint(F.col("edited")))
    return t.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
