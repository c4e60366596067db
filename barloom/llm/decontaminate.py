"""Benchmark decontamination: short test items found inside long documents.

Only built-in functions.  The project keeps no test items (its "benchmark" is a
return series), so the interface is general: ``documents(doc_id, text)`` and
``items(item_id, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import narrowed, stored

#: Words of a shingle and the share of an item's shingles that a document must have.
WORDS, PERCENT = 5, 80


def words_of(text: str) -> Column:
    """Lower-cased runs without blanks; null has none."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def _runs(w: Column, k: int, make) -> Column:
    """``make`` of every run of ``k`` words, in order."""
    runs = F.transform(w, lambda x, i: make(x, *[F.get(w, i + F.lit(j)) for j in range(1, k)]))
    return F.slice(runs, 1, F.greatest(F.size(w) - F.lit(k - 1), F.lit(0)))


def shingle_marks(words: Column, k: int) -> Column:
    return _runs(words, k, F.xxhash64)


def shingle_texts(words: Column, k: int) -> Column:
    return _runs(words, k, lambda *x: F.concat_ws(" ", *x))


def _by_length(k: str, make) -> Column:
    """``make(n)`` for the row's number of words ``k``."""
    out = make(WORDS)
    for n in range(1, WORDS):
        out = F.when(F.col(k) == n, make(n)).otherwise(out)
    return out


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Bottom MinHash values of every item, as many as its size class calls for.

    Items are partitioned by the bit length of their number of shingles.  An
    item of ``n`` shingles keeps its ``n - ceil(percent * n / 100) + 1``
    smallest hashes: a document with the required share must have one of them.
    ``bound`` is the largest hash kept in the size class, so a document shingle
    above it needs no probe there.
    """
    kept = F.expr(f"CAST(n - ceil(n * {percent} / 100.0) + 1 AS INT)")
    rows = (
        items.select("item", "k", F.array_distinct("marks").alias("marks"))
        .withColumn("n", F.size("marks"))
        .withColumn("size_class", F.floor(F.log2("n")).cast("int"))
        .select("item", "k", "n", "size_class",
                F.explode(F.slice(F.array_sort("marks"), F.lit(1), kept)).alias("mark"))
    )
    bounds = rows.groupBy("k", "size_class").agg(F.max("mark").alias("bound"))
    return rows.join(bounds, ["k", "size_class"])


def _probes(docs: DataFrame, classes: list, percent: int) -> DataFrame:
    """Shingle hashes of documents, ``(doc, k, size_class, mark)``, for each class that can have an answer.

    A document needs ``percent`` of the shingles of an item, so it does not ask
    the classes whose items are all too large for it, and asks a class only for
    hashes up to the largest one its sketches keep.
    """
    lengths = sorted({c["k"] for c in classes})
    marked = docs.select("doc", words_of("text").alias("w")).select(
        "doc", *[F.array_distinct(shingle_marks(F.col("w"), k)).alias(f"m{k}") for k in lengths]
    )
    asked = []
    for c in classes:
        marks = F.col(f"m{c['k']}")
        least = -(-percent * (1 << c["size_class"]) // 100)

        def one(mark: Column) -> Column:
            return F.struct(F.lit(c["k"]).alias("k"), F.lit(c["size_class"]).alias("size_class"), mark.alias("mark"))

        small = F.transform(F.filter(marks, lambda m: m <= c["bound"]), one)
        asked.append(F.when(F.size(marks) >= least, small).otherwise(F.filter(small, lambda x: F.lit(False))))
    return marked.select("doc", F.explode(F.flatten(F.array(*asked))).alias("p")).select("doc", "p.*")


def contained_items(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(doc_id, item_id)`` where the document holds the item.

    A pair is reported when at least ``percent`` of the item's distinct
    five-word shingles occur in the document; an item of fewer words is one
    shingle of all its words.  Returns ``doc_id, item_id, item_shingles,
    shared_shingles, containment``.

    * Sketches propose pairs (they cannot miss one), shingle texts decide.  Items
      are partitioned by their number of shingles; every partition has sketches
      and a bound of its own, and documents ask only those that can answer.
    * Null or empty texts hold nothing and are held nowhere; the same goes for
      documents shorter than the item's shingles.
    * Rows that repeat an id count as one document (item) with several texts:
      the best one is reported, once.  So do the rows without an id, which are
      reported under a null id.
    * Empty tables give an empty result; other columns are ignored.
    """
    # a struct with a null in it is itself not null, so rows without an id join like others
    docs = documents.select(F.struct("doc_id").alias("doc"), "text")
    tests = (
        items.select(F.struct("item_id").alias("item"), words_of("text").alias("w"))
        .where(F.size("w") > 0)
        .withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    )
    marked = tests.select("item", "k", _by_length("k", lambda n: shingle_marks(F.col("w"), n)).alias("marks"))
    sketch = stored(item_sketches(marked, percent))
    # at most WORDS lengths by the bits of an item's size
    classes = sketch.groupBy("k", "size_class").agg(F.first("bound").alias("bound")).orderBy("k", "size_class").collect()
    if not classes:
        return docs.join(items.select("item_id"), F.lit(False)).select(
            "doc.doc_id", "item_id", *[F.lit(0).cast("bigint").alias(c) for c in ("item_shingles", "shared_shingles")],
            F.lit(0.0).alias("containment"),
        )
    pairs = stored(
        _probes(docs, classes, percent).join(sketch.select("k", "size_class", "mark", "item"), ["k", "size_class", "mark"])
        .select("doc", "k", "item").distinct()
    )
    wanted = stored(pairs.select("doc").distinct())
    # the words are a column of their own: inside the lambda they would be split for every run
    texts = narrowed(docs, wanted, "doc").join(wanted, "doc", "left_semi").select("doc", words_of("text").alias("w"))
    grams = tests.select(
        "item", "k", F.array_distinct(_by_length("k", lambda n: shingle_texts(F.col("w"), n))).alias("grams")
    )
    found = (
        pairs.join(texts, "doc").join(grams, ["item", "k"])
        .withColumn("doc_grams", _by_length("k", lambda n: shingle_texts(F.col("w"), n)))
        .select(
            "doc.doc_id", "item.item_id", F.size("grams").cast("bigint").alias("item_shingles"),
            F.size(F.array_intersect("grams", "doc_grams")).cast("bigint").alias("shared_shingles"),
        )
        .where(F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent)
    )
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
                       "item_shingles", "shared_shingles")).alias("b")
    )
    return best.select("doc_id", "item_id", "b.item_shingles", "b.shared_shingles", "b.containment")
