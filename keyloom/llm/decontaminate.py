"""Benchmark decontamination: size-partitioned MinHash containment search, with built-in Spark functions only.

Test items are short and documents long, so similarity is containment: the part of an item's distinct five-word
shingles that the document holds. An item's sketch is its s smallest shingle hashes, where s is the number of shingles
it can miss at the wanted containment, plus one, so a document that contains enough of it has one of them. Items are
partitioned by size (powers of two of their shingle count), and each partition has a threshold, its largest sketch
hash: of a document only the hashes up to the threshold of the partitions that it is long enough for are looked up, and
only in the sketches. What that finds are candidates; their documents are read again, and the shingles themselves, as
text, are counted against the item's.

Words are runs of letters, marks and digits in lower case. Defined cases: items and documents with fewer than `n`
words (null and empty texts too) have no shingle and match nothing; `matches` and `contaminated` answer by doc_id as
the query's SQL does, where the rows of one doc_id (null is one too) are one document of all their shingles, while
`decontaminate` judges every row by its own text whatever its id; items with the same id are one item; other columns
are ignored; an empty table gives no match. Hits are rare and counted per (document, item) with partial aggregation;
no pairs of documents arise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, fresh, row_key

#: Up to this many sketch entries, item shingles or candidates are broadcast (tens of MB), beyond they are shuffled.
BROADCAST_ENTRIES = 500_000
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: F.length(w) > 0)


def _hashed_words(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _shingles(hw: str, n: int) -> Column:
    """Hashes of the n-word shingles; `hw` must be a column, or each step would split the text anew."""
    grams = F.transform(F.sequence(F.lit(0), F.size(hw) - n), lambda i: F.xxhash64(*[F.get(F.col(hw), i + j) for j in range(n)]))
    return F.when(F.size(hw) >= n, grams).otherwise(F.array().cast("array<bigint>"))


def _texts(words: str, n: int) -> Column:
    """The n-word shingles themselves."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(F.col(words), i, n), " "))).otherwise(F.array().cast("array<string>"))


def _near(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ENTRIES else rows


def sketches(items: DataFrame, containment: float, n: int) -> DataFrame:
    """item_id, part (the size partition), need (shingles that make a match), sketch (the hashes searched)."""
    hashed = fresh(items, "item_id", "text").select("item_id", _hashed_words(F.col("text")).alias("hw"))
    rows = hashed.select("item_id", F.explode(_shingles("hw", n)).alias("h")).distinct()
    sized = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    size = F.size("hs")
    need = F.ceil(F.round(F.lit(containment) * size, 6)).cast("int")
    return sized.select("item_id", F.floor(F.log2(size)).cast("int").alias("part"), need.alias("need"), F.slice("hs", 1, size - need + 1).alias("sketch"))


def candidates(docs: DataFrame, key: Column, sketched: DataFrame, n: int, by_size: bool) -> DataFrame:
    """key, item_id: the documents that have a hash of an item's sketch."""
    # A row for each power of two of the items' sizes.
    parts = sketched.groupBy("part").agg(F.max(F.array_max("sketch")).alias("threshold"), F.min("need").alias("least")).collect()
    entries = sketched.select(F.explode("sketch").alias("h"), "item_id")
    hashed = docs.select(key.alias("key"), _hashed_words(docs["text"]).alias("hw")).where(F.size("hw") >= n)
    long_enough = [F.when(F.size("hw") >= (p["least"] + n - 1 if by_size else n), F.lit(p["threshold"])) for p in parts]
    top = reduce(lambda a, b: F.greatest(a, b), long_enough, F.lit(None).cast("long"))  # of nulls and numbers the largest number
    few = hashed.select("key", F.explode(F.filter(_shingles("hw", n), lambda h: h <= top)).alias("h"))
    return few.join(_near(entries), "h").select("key", "item_id").distinct()


def _matches(docs: DataFrame, key: Column, items: DataFrame, containment: float, n: int, by_size: bool) -> DataFrame:
    """key, item_id, n_common, need: the pairs in which the rows with the key contain the item. By size, documents are
    searched for the partitions whose items they can hold; not if several rows are one document."""
    sketched = cut(sketches(items, containment, n))
    found = cut(candidates(docs, key, sketched, n, by_size))
    keys = _near(found.select(F.col("key").alias("own")).distinct())
    again = docs.select(key.alias("key"), docs["text"].alias("text")).join(keys, F.col("key").eqNullSafe(F.col("own")), "left_semi")
    own = again.select("key", _words(F.col("text")).alias("w")).select("key", F.explode(_texts("w", n)).alias("g"))
    wanted = fresh(items, "item_id", "text").join(F.broadcast(sketched.select("item_id", "need")) if sketched.count() <= BROADCAST_ENTRIES else sketched.select("item_id", "need"), "item_id")
    wanted = wanted.select("item_id", "need", _words(F.col("text")).alias("w")).select("item_id", "need", F.explode(_texts("w", n)).alias("g")).distinct()
    common = own.join(_near(cut(wanted)), "g").groupBy("key", "item_id", "g").agg(F.max("need").alias("need"))
    counted = common.groupBy("key", "item_id").agg(F.count("*").alias("n_common"), F.max("need").alias("need"))
    return counted.where("n_common >= need").select("key", "item_id", "n_common", "need")


def matches(docs: DataFrame, items: DataFrame, containment: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, item_id, n_common, need: the pairs in which the document contains the item."""
    return _matches(docs, docs["doc_id"], items, containment, n, by_size=False).withColumnRenamed("key", "doc_id")


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, n_items, first_item for the documents that contain an item."""
    return matches(docs, items, containment, n).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = 0.8, n: int = 5) -> DataFrame:
    """`docs` without the rows whose text contains an item; all columns stay."""
    bad = cut(_matches(docs, row_key(docs), items, containment, n, by_size=True).select("key").distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ENTRIES else bad
    return docs.join(bad, row_key(docs) == bad["key"], "left_anti")
