"""Secret scans over an incremental blob ledger, in built-in functions only.

Every version of every path is addressed by the SHA-256 of its content.  A
ledger holds, per blob and rule version, the findings of blobs scanned so far.
A run scans each blob once, and only those (blob, rule version) pairs that the
ledger lacks; the new rows extend the ledger, and findings join back to every
path and version that holds the blob.  ``BlobLedger`` keeps both the findings
and the paths as tables in a shared folder, from one run to the next.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreframe.llm.common import cut, fresh, let, sized


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups; matches with a
    shorter group are dropped after matching, so they still consume text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: fixed values: the base rules, then the further ones; spans of one start are
#: listed in this order.  A run of 24 or more hex digits is the same as any
#: run kept if it has 24; likewise for access keys of 20 characters.
BASE_RULES = [
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
                   r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
RULE_VERSION = "1"
#: what ends a key block, and inside one that lacks its END line the first
#: thing that is not key text: a blank line, or a word that is neither a long
#: base64 run, nor a padded one, nor base64 alone on its line
_PEM_MARK = r"-----(?:BEGIN |END [A-Z ]*PRIVATE KEY-----)"
_PEM_LEAD = r"^[ \t\r]*(?:\n[ \t]*(?:Proc-Type|DEK-Info):[^\n]*){1,8}\n(?:[ \t\r]*\n)?"
_PEM_STOP = (r"\n[ \t\r]*\n|(?<!\S)(?![A-Za-z0-9+/]{24,}={0,2}(?!\S)|[A-Za-z0-9+/]*={1,2}(?!\S)"
             r"|(?<=(?:\A|\n)[ \t]{0,64})[A-Za-z0-9+/]+[ \t\r]*(?:\n|\z))\S")
_BLOCK = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _before(values: Column) -> Column:
    """For every entry the sum of the entries before it (block sums keep this
    near-linear for texts with very many matches)."""
    def body(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
                             lambda b: _sum(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda bs: F.transform(v, lambda _, i: (
            _sum(F.slice(bs, F.lit(1), F.floor(i / _BLOCK).cast("int")))
            + _sum(F.slice(v, i - i % _BLOCK + 1, i % _BLOCK)))))
    return let(values, body)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, leftmost and non-overlapping, in code points:
    the pieces between matches and the matches alternate, so their lengths
    add up to positions."""
    pattern = F.lit(rule.pattern)
    steps = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("m"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("g"),
        F.transform(F.split(text, rule.pattern), F.length).alias("p"))

    def place(s: Column) -> Column:
        step = F.transform(s, lambda x: x["p"] + F.coalesce(x["m"], F.lit(0)))
        return F.transform(F.filter(F.arrays_zip(s.alias("s"), _before(step).alias("b")),
                                    lambda x: x["s"]["g"] >= rule.least),
                           lambda x: F.struct(
                               (x["b"] + x["s"]["p"]).alias("start"), F.lit(rank).alias("rank"),
                               (x["b"] + x["s"]["p"] + x["s"]["m"]).alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(F.rlike(text, pattern), let(steps, place)).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: list[Rule]) -> Column:
    return F.sort_array(F.concat(*[rule_spans(text, r, n) for n, r in enumerate(rules)]))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def empty_ledger(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([], f"blob binary, rule_version string, spans {SPANS}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text",
                  rules: list[Rule] | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows ``(blob, rule_version, spans)``: one for each blob of
    ``versions`` that ``ledger`` does not hold under ``rule_version``.

    Null text: the blob of the empty text.  Repeated rows and equal texts: one
    blob.  Empty table: no rows.
    """
    rules = rules or BASE_RULES + MORE_RULES
    blobs = versions.select(_blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    return (blobs.groupBy("blob").agg(F.first("text").alias("text"))
            .select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("text"), rules).alias("spans")))


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text",
             rule_version: str = RULE_VERSION) -> DataFrame:
    """``(path_col, spans)`` of every row of ``versions``: the ledger's
    findings of its blob (null if the blob was never scanned)."""
    held = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans")
    return (versions.select(F.col(path_col), _blob(F.col(text_col)).alias("blob"))
            .join(held, "blob", "left").select(path_col, "spans"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text", rules: list[Rule] | None = None,
                rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``(per row findings, ledger after the run)``: scans what the ledger
    lacks and joins all findings back to the rows.

    Null or empty text: no spans.  Null ids and repeated rows: one result per
    row.  Empty table: no rows.  Columns besides the two named are not read.
    """
    d = docs.select(F.col(id_col), F.col(text_col))
    new = cut(scan_versions(d, ledger, text_col, rules, rule_version))
    full = new if ledger is None else ledger.unionByName(new)
    return findings(d, full, id_col, text_col, rule_version), full


class BlobLedger:
    """A ledger in the folder ``path`` (shared by driver and executors).

    ``found`` holds (blob, rule_version, spans), appended to by every scan;
    ``paths`` holds (path, blob) of every row of every arrival, one partition
    an arrival.  An arrival is any set of rows that came together: a crawl, a
    commit, a day.  A scan that died may be repeated: its arrival is written
    anew, and blobs it had appended are not scanned again.  Two scans at once
    may both scan a blob; its equal findings count once.  Change
    ``rule_version`` with the rules: older findings stay under their own.
    """

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule] | None = None,
                 rule_version: str = RULE_VERSION):
        self.spark, self.rules, self.rule_version = spark, rules, rule_version
        self._found, self._paths = f"{path}/found", f"{path}/paths"
        empty_ledger(spark).write.mode("ignore").parquet(self._found)

    def found(self) -> DataFrame:
        """``(blob, rule_version, spans)`` of all blobs scanned so far."""
        kept = self.spark.read.schema(f"blob binary, rule_version string, spans {SPANS}").parquet(self._found)
        return kept.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))

    def scan(self, versions: DataFrame, arrival: str, path_col: str = "doc_id", text_col: str = "text") -> None:
        """Scans the blobs of ``versions`` that the ledger lacks under its
        rule version, and keeps their findings and all paths.

        Null or empty text: the blob of the empty text.  Null paths and
        repeated rows: kept as they are.  Empty table: an arrival of no rows.
        """
        if not re.fullmatch(r"[A-Za-z]\w*", arrival):
            raise ValueError(f"the name of an arrival is a word, not {arrival!r}")
        d = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
        (d.select("path", _blob(F.col("text")).alias("blob"))
         .write.mode("overwrite").parquet(f"{self._paths}/arrival={arrival}"))
        (scan_versions(d, self.found(), "text", self.rules, self.rule_version)
         .write.mode("append").parquet(self._found))

    def history(self, path_col: str = "doc_id") -> DataFrame:
        """``(arrival, path_col, spans)`` of every row that ever arrived
        (spans null: not yet scanned under this rule version)."""
        held = self.found().where(F.col("rule_version") == self.rule_version).select("blob", "spans")
        return (self.spark.read.option("basePath", self._paths).parquet(f"{self._paths}/arrival=*")
                .join(held, "blob", "left")
                .select(F.col("arrival").cast("string").alias("arrival"), F.col("path").alias(path_col), "spans"))


def _pem_rest(rest: Column) -> Column:
    """Length of the key block whose BEGIN line ends where ``rest`` starts:
    through its END line, or without one the base64 lines that follow.  Line
    breaks may be escaped; quotes and comment marks count as blanks."""
    mark = F.regexp_extract(rest, _PEM_MARK, 0)
    body = F.split(rest, _PEM_MARK, 2)[0]

    def lines(b: Column) -> Column:
        plain = F.translate(F.regexp_replace(b, r"\\[nr]", " \n"), "\"'#>*|,;", " " * 8)
        lead = F.regexp_extract(plain, _PEM_LEAD, 0)
        key = F.split(F.substring(plain, F.length(lead) + 1, F.length(plain)), _PEM_STOP, 2)[0]
        return F.length(F.regexp_replace(F.concat(lead, key), r"\s+\z", ""))

    return let(F.struct(mark.alias("mark"), body.alias("body")), lambda x: F.when(
        F.startswith(x["mark"], F.lit("-----END")), F.length(x["body"]) + F.length(x["mark"])).otherwise(let(x["body"], lines)))


def whole_blocks(text: Column, spans: Column) -> Column:
    """``spans`` with those of kind pem, which the rule ends with the BEGIN
    line, stretched over the key block."""
    def stretch(s: Column) -> Column:
        rest = F.substring(text, s["end"] + 1, F.length(text))
        return s.withField("end", F.when(s["kind"] == "pem", s["end"] + let(rest, _pem_rest)).otherwise(s["end"]))
    return F.transform(spans, stretch)


def redact(docs: DataFrame, ledger: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
           rule_version: str = RULE_VERSION, broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``
    (overlapping spans by one, a private key as its whole block); other columns
    unchanged."""
    blob, found = fresh(docs, "blob", "spans")
    held = sized(cut(ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(
        F.col("blob").alias(blob), F.col("spans").alias(found))), broadcast_rows)
    text = F.col(text_col)

    def fill(spans: Column) -> Column:
        opened = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.when(
            s["end"] <= a["at"], a).otherwise(F.struct(F.greatest(s["end"], a["at"]).alias("at"), F.concat(
                a["out"], F.when(s["start"] >= a["at"], F.concat(
                    F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")).alias("out"))))
        return let(opened, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    joined = docs.withColumn(blob, _blob(text)).join(held, blob, "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(
        let(whole_blocks(text, F.col(found)), fill))).select(*docs.columns)
