"""Quality rules with cross-document line frequency, in built-in functions only.

Lines are normalised (lower case, white space collapsed) and hashed.  Per host
the number of distinct documents that hold a line is counted; equal texts
count once, so a page is not boilerplate because it was crawled many times.
Lines above a limit (a share of the host's documents, or a number of them that
is enough at any host) are removed, and documents that lose more than a share
of their words are rejected, as are those that fail the base rules.

The distinct documents of a host are kept once as arrays of line hashes, eight
bytes a line, for all that is counted.  A host has at most (mean lines per
document / share) lines above the share, so they travel to its documents as one
short array.  Lines above the number alone may be many at a large host: they
are joined as rows to the line hashes, and only what a document holds itself
travels to it.  Lines are never shuffled as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import SPACE_RE, cut, let, sized, words_of

#: fixed values: characters that count as symbols
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE_RE, " ")))


def line_hashes(text: Column) -> Column:
    """Hashes of the text's lines with a word, in order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                     lambda x: F.translate(x, _SPACES, "") != "")
    return F.transform(lines, lambda x: F.xxhash64(normal_line(x)))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by ``width``-word windows that occur twice or more."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = let(pairs, lambda s: F.filter(
            F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"])
                                               | (x["h"] == F.get(s, i + 1)["h"]), x["at"])),
            lambda x: x.isNotNull()))
        return let(F.sort_array(again), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
            F.lit(0), lambda a, x: a + x))

    return let(words, lambda w: F.when(F.size(w) < width + 1, 0).otherwise(
        let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))))


def base_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(t, _SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(words).cast("long"),
    }


def content_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def common_lines(docs: DataFrame, host_col: str, text_col: str, min_docs: int, max_share: float,
                 max_docs: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(host, common)``, per host the hashes of the lines above the share,
    and ``(host, content, own)``, per text the hashes of its lines that are
    above the number alone."""
    d = cut(docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                        content_hash(F.col(text_col)).alias("content"),
                        F.array_distinct(line_hashes(F.col(text_col))).alias("lines"))
            .dropDuplicates(["host", "content"]))
    lines = d.select("host", "content", F.explode("lines").alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    sizes = d.groupBy("host").agg(F.count("*").alias("docs"))
    over = cut(seen.join(sizes, "host").select("host", "line", "n", (F.col("n") > max_share * F.col("docs")).alias("share"))
               .where(F.col("share") | (F.col("n") >= max_docs)))
    common = over.where("share").groupBy("host").agg(F.collect_list("line").alias("common"))
    rest = sized(over.where("not share").select("host", "line"), broadcast_rows)
    own = lines.join(rest, ["host", "line"]).groupBy("host", "content").agg(F.collect_list("line").alias("own"))
    return cut(common), cut(own)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", min_docs: int = 10, max_share: float = 0.05,
                  max_removed: float = 0.5, broadcast_hosts: int = 100_000,
                  max_docs: int = 1000) -> DataFrame:
    """One row per document: ``id_col``, the base columns ``n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, then
    ``n_common_lines``, ``n_common_words`` (what the line limits remove),
    ``kept`` and ``clean_text`` (the text without those lines).

    A line goes if at least ``min_docs`` distinct documents of the host, and
    more than ``max_share`` of them, hold it, or if ``max_docs`` do, whatever
    the host's size; a document is rejected if it loses more than
    ``max_removed`` of its words.

    Null or empty text: no words, so base_failed.  Null host: a host of its
    own.  Null ids and repeated rows: judged like any row; equal texts of a
    host count as one document.  Empty table: no rows.
    """
    common, own = (sized(x, broadcast_hosts)
                   for x in common_lines(docs, host_col, text_col, min_docs, max_share, max_docs, broadcast_hosts))
    text = F.col("text")
    none = F.array().cast("array<bigint>")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                    F.col(text_col).alias("text"), content_hash(F.col(text_col)).alias("content"))
    marked = d.join(common, "host", "left").join(own, ["host", "content"], "left").select(
        "id", "text", F.concat(F.coalesce("common", none), F.coalesce("own", none)).alias("common"))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    gone = F.when(F.size("common") == 0, F.array().cast("array<string>")).otherwise(F.filter(
        lines, lambda x: (F.translate(x, _SPACES, "") != "")
        & F.array_contains(F.col("common"), F.xxhash64(normal_line(x)))))
    kept_lines = F.filter(lines, lambda x: ~F.array_contains(F.col("common"), F.xxhash64(normal_line(x)))
                          | (F.translate(x, _SPACES, "") == ""))
    r = marked.select("id", *[c.alias(k) for k, c in base_columns(text).items()],
                      let(gone, lambda g: F.struct(
                          F.size(g).cast("long").alias("lines"),
                          F.size(words_of(F.array_join(g, "\n"))).cast("long").alias("words"))).alias("gone"),
                      F.when(F.size("common") == 0, text).otherwise(F.array_join(kept_lines, "\n")).alias("clean_text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return r.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("gone.lines").alias("n_common_lines"),
        F.col("gone.words").alias("n_common_words"),
        (~failed & (F.col("gone.words") <= max_removed * F.col("n_words"))).alias("kept"), "clean_text")
