"""Secret scans over versioned texts with an incremental blob ledger.

A version (path and text) is addressed by the SHA-256 of its text. The ledger
keeps which blob was scanned by which rule version, and what was found. A scan
reads only blobs with a pair that the ledger lacks, once for all paths that hold
them, appends to the ledger, and joins findings back to all paths of the blob.

DataFrame functions only. Java's regular expressions don't give positions, so the
text is split at the matches: the lengths of pieces and matches before a match
add up to its start (in code points).

A null text is the empty blob. A null or repeated path is kept; each row gets the
findings of its own text. Columns other than path and text are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import written


@dataclass(frozen=True)
class Rule:
    """``least``: shortest accepted length of ``group`` (0: the match).
    ``guard``: what a text with an accepted match contains; tried first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    guard: str | None = None
    version: str = field(init=False)

    def __post_init__(self):
        seed = f"{self.kind} {self.pattern} {self.group} {self.least}"
        object.__setattr__(self, "version", f"{self.kind}@{hashlib.sha256(seed.encode()).hexdigest()[:12]}")


# The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
# A PEM key runs to its END line. Where that is missing (the text is cut
# off), to the last line of base64: quoted, escaped or indented lines of 16 and more,
# and a shorter one that ends the line or the text. Possessive, so nothing backtracks.
KEY_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
KEY_BODY = (
    r"(?:(?:[^-]|-(?!----))*+-{5,}END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\s\\nr]*+(?:Proc-Type:\s*+4,ENCRYPTED|DEK-Info:\s*+[A-Z0-9-]++,[0-9A-Fa-f]++))*+"
    r"""(?:[\s\\>#|*"',;+/]*+[A-Za-z0-9+/=]{16,}+)*+"""
    r"""(?:[\s\\>#|*"',;]++[A-Za-z0-9+/=]++(?=["',;]*+[\r\n\\]|\s*+-|\s*+(?![\s\S])))?+)"""
)
# Published formats of well-known credentials.
MORE = (
    Rule("private_key", KEY_HEADER + KEY_BODY, 0, 1, KEY_HEADER),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + MORE
#: Paths with findings are broadcast up to this many (about 20 MB), and shuffled beyond.
BROADCAST_ROWS = 100_000
MATCHES = "array<struct<piece:int,whole:int,part:int>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: length of the piece before it, its length, its group's length."""
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("piece"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x)).alias("whole"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)).alias("part"),
    )
    return F.filter(found, lambda x: x["whole"].isNotNull()).cast(MATCHES)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """sha, rule, kind, start, end (exclusive) of all accepted matches.

    ``blobs``: sha, text, ``pending`` (versions of the rules to try)."""
    text = F.coalesce("text", F.lit(""))
    tried = [
        F.struct(
            F.lit(r.version).alias("rule"),
            F.lit(r.kind).alias("kind"),
            F.lit(r.least).alias("least"),
            F.when(F.array_contains("pending", r.version) & text.rlike(r.guard or r.pattern), _matches(text, r)).alias("found"),
        )
        for r in rules
    ]
    per_rule = blobs.select("sha", F.explode(F.array(*tried)).alias("t")).where(F.size("t.found") > 0)
    # Rows that repeat a path and its text bring the same blob twice.
    rows = (
        per_rule.select("sha", "t.rule", "t.kind", "t.least", F.posexplode("t.found").alias("i", "m"))
        .select("sha", "rule", "kind", "least", "i", "m.*")
        .dropDuplicates(["sha", "rule", "i"])
    )
    so_far = Window.partitionBy("sha", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("piece") + F.col("whole")).cast("long")).over(so_far)
    return (
        rows.withColumn("end", end)
        .where(F.col("part") >= F.col("least"))
        .select("sha", "rule", "kind", (F.col("end") - F.col("whole")).alias("start"), "end")
    )


class Ledger:
    """Two tables in a shared folder: pairs of blob and rule version that have been
    scanned, and findings. Findings are written before the pairs: a run that is
    lost in between scans these blobs again, and readers drop what stands twice."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        reader = self.spark.read.schema(schema)
        return reader.parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", "sha string, rule string")

    def findings(self) -> DataFrame:
        """Of the present rule versions; those of replaced ones stay in the table."""
        rows = self._read("findings", "sha string, rule string, kind string, start long, end long")
        return rows.where(F.col("rule").isin([r.version for r in self.rules])).distinct()

    def pending(self, addresses: DataFrame) -> DataFrame:
        """sha, one path that holds it, and rule versions that it wasn't scanned by."""
        blobs = addresses.groupBy("sha").agg(F.min("path").alias("path"))
        done = self.seen().groupBy("sha").agg(F.collect_set("rule").alias("done"))
        every = F.array(*[F.lit(r.version) for r in self.rules])
        todo = F.coalesce(F.array_except(every, "done"), every)
        return blobs.join(done, "sha", "left").select("sha", "path", todo.alias("pending")).where(F.size("pending") > 0)

    def scan(self, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Bring the ledger up to date; path, sha of each given version, one row each."""
        rows = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("sha", address(F.col("text")))
        addresses = written(rows.select("path", "sha"), "addresses")
        todo = written(self.pending(addresses), "pending")
        same = rows["path"].eqNullSafe(todo["path"]) & (rows["sha"] == todo["sha"])
        blobs = rows.join(todo.hint("shuffle_hash"), same).select(rows["sha"], "text", "pending")
        find(blobs, self.rules).write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("sha", F.explode("pending").alias("rule")).write.mode("append").parquet(f"{self.folder}/seen")
        return addresses


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def spans_of_paths(addresses: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, sha and ``spans`` (kind, start, end by start, then kind as listed) of every version."""
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    per_blob = findings.groupBy("sha").agg(
        F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,kind:string>>")
    return addresses.join(per_blob, "sha", "left").select("path", "sha", F.coalesce("spans", none).alias("spans"))


def digests(paths: DataFrame) -> DataFrame:
    """Counts of the base kinds and both lists of spans, per path."""
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return paths.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, paths: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace every span by ``[kind]``; overlapping spans fall under the first.

    Texts without findings stay as they are. Rows are matched by path and address."""
    found = written(paths.where(F.size("spans") > 0).select("path", "sha", "spans").distinct(), "found")
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.col(text_col).substr(acc["at"].cast("int"), F.greatest(x["start"] + 1 - acc["at"], F.lit(0)).cast("int"))
        fresh = x["start"] + 1 >= acc["at"]
        out = F.concat(acc["out"], F.when(fresh, F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"] + 1).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.col(text_col).substr(acc["at"].cast("int"), F.length(text_col)))

    same = docs[path_col].eqNullSafe(found["path"]) & (address(docs[text_col]) == found["sha"])
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("shuffle_hash")
    joined = docs.join(side, same, "left")
    text = F.when(F.col("spans").isNotNull(), F.aggregate("spans", start, add, finish)).otherwise(F.col(text_col))
    kinds = docs.schema
    return joined.select(*[text.alias(text_col) if c == text_col else docs[c] for c in kinds.names])
