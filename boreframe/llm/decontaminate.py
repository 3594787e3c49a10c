"""Benchmark decontamination by size-partitioned MinHash containment search,
in built-in functions only.

Test items are short and documents long, so a sketch must keep enough hashes
of the item, not of the document.  Items are partitioned by their number of
distinct shingles (powers of two).  An item's sketch is its ``sketch``
smallest shingle hashes; a partition's threshold is the largest hash in any of
its sketches, and a document's sketch for the partition is all its shingle
hashes up to that threshold.  So the bigger the items, the smaller the share
of a document that takes part, and an item that a document holds whole is
always found: every hash of its sketch is in the document's sketch.  An item
at containment c is missed only if all its smallest hashes fall on shingles
that the document lacks: about (1 - c) ** sketch (0.2 ** 12 = 4e-9 at 0.8).

Candidates (document and item share a sketch hash) are verified by the exact
containment of the item's shingles, compared as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut, fresh, let, sized

SHINGLE = 5
#: words: letters and digits, and all characters beyond ASCII; case is ignored
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def content_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def shingles(words: Column, k: int) -> Column:
    """The ``k``-word shingles of a bound array, in order (none if shorter)."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.concat_ws(" ", *[F.get(words, i + n) for n in range(k)]))
    ).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(k)]))
    ).otherwise(F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame, item_col: str, text_col: str, k: int, sketch: int) -> DataFrame:
    """``(item, width, shingles, part, sketch)``; an item of fewer than ``k``
    words has one shingle, all its words, of that width."""
    words = items.select(F.col(item_col).alias("item"), content_words(F.col(text_col)).alias("words"))
    cases = None
    for width in range(1, k + 1):
        fits = F.size("words") == width if width < k else F.size("words") >= k
        s = F.struct(F.lit(width).alias("width"),
                     F.array_distinct(let(F.col("words"), lambda w: shingles(w, width))).alias("shingles"),
                     F.sort_array(F.array_distinct(let(F.col("words"), lambda w: shingle_hashes(w, width)))).alias("hashes"))
        cases = F.when(fits, s) if cases is None else cases.when(fits, s)
    return (words.where(F.size("words") > 0).select("item", cases.alias("s"))
            .select("item", "s.width", "s.shingles",
                    F.floor(F.log2(F.size("s.shingles"))).cast("int").alias("part"),
                    F.slice("s.hashes", 1, sketch).alias("sketch")).distinct())


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE,
                    min_containment: float = 0.8, sketch: int = 12,
                    broadcast_rows: int = 500_000) -> DataFrame:
    """Pairs ``(id_col, item_col, n_shingles, n_common, containment)`` of a
    document and an item of whose distinct shingles the document holds at
    least ``min_containment``.

    Words ignore case and punctuation.  Null, empty or wordless texts and
    items match nothing; items of fewer than ``k`` words must stand whole.
    Null ids and repeated rows: a pair is listed once per distinct (id, text,
    item).  Empty tables: no rows.
    """
    return (_contained(docs, items, id_col, text_col, item_col, item_text_col, k, min_containment, sketch,
                       broadcast_rows)
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_common", "containment"))


def _contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
               k: int, min_containment: float, sketch: int, broadcast_rows: int) -> DataFrame:
    """The pairs with the hash of the document's text (``content``)."""
    sk = cut(item_sketches(items, item_col, item_text_col, k, sketch))
    hashes = sk.select("item", "width", "part", F.explode("sketch").alias("hash"))
    limits = hashes.groupBy("width", "part").agg(F.max("hash").alias("top")).collect()  # <= 5 x 60 rows
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    tops: dict[int, list] = {}
    for r in sorted(limits):
        tops.setdefault(r["width"], []).append((r["part"], r["top"]))
    build = sized(hashes, broadcast_rows)
    pairs = cut(d.select("id", "content", F.explode(let(content_words(F.col("text")), lambda w: F.concat(
                    F.array().cast(_ENTRIES), *[_sketches(w, width, parts) for width, parts in tops.items()]))).alias("s"))
                .select("id", "content", "s.*").join(build, ["width", "part", "hash"])
                .select("id", "content", "item").distinct())
    near = sized(pairs, broadcast_rows).select(
        F.col("id").alias("p_id"), F.col("content").alias("p_content"), F.col("item").alias("p_item"))
    whole = sized(sk.select("item", "width", "shingles"), 20_000)
    both = (d.join(near, F.expr("id <=> p_id and content = p_content"))
            .join(whole, F.expr("p_item <=> item")))
    common = F.lit(0)
    for width in tops:
        held = let(content_words(F.col("text")), lambda w: shingles(w, width))  # noqa: B023
        common = F.when(F.col("width") == width, F.size(F.array_intersect(F.col("shingles"), held))).otherwise(common)
    n = F.size("shingles")
    return (both.select("id", "content", "item", n.cast("long").alias("n_shingles"), common.cast("long").alias("n_common"))
            .withColumn("containment", F.col("n_common") / F.col("n_shingles"))
            .where(F.col("containment") >= min_containment).distinct())


_ENTRIES = "array<struct<width:int,part:int,hash:bigint>>"


def _sketches(words: Column, width: int, parts: list[tuple[int, int]]) -> Column:
    """A document's sketches for the partitions ``(part, threshold)``."""
    def entries(h: Column) -> Column:
        return F.concat(*[entry(h, part, top) for part, top in parts])

    def entry(h: Column, part: int, top: int) -> Column:
        small = F.array_distinct(F.filter(h, lambda x: x <= top))
        return F.transform(small, lambda x: F.struct(
            F.lit(width).alias("width"), F.lit(part).alias("part"), x.alias("hash")))

    return let(shingle_hashes(words, width), entries)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE,
                  min_containment: float = 0.8, sketch: int = 12, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay.

    Rows go by id and text: another text under the same id stays, and so do
    null and empty texts.  Null ids and repeated rows are judged like any.
    """
    hit_id, hit_content = fresh(docs, "hit_id", "hit_content")
    hits = cut(_contained(docs, items, id_col, text_col, item_col, item_text_col, k, min_containment, sketch,
                          broadcast_rows)
               .select(F.col("id").alias(hit_id), F.col("content").alias(hit_content)).distinct())
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(sized(hits, broadcast_rows), docs[id_col].eqNullSafe(F.col(hit_id))
                     & (content == F.col(hit_content)), "left_anti")
