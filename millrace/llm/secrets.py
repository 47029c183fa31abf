"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger, a Parquet
table, says for each blob which versions of which rules have seen it and what they found. A scan
reads the ledger, runs only the pairs of blob and rule version that it lacks, once for each
distinct text, appends them, and joins what is found back to all rows that hold the blob. A new
rule, or a new version of one, scans all blobs for that rule alone; an unchanged corpus scans
nothing. All of it is DataFrame functions.

Start and end of a finding count code points; the end is exclusive.

Defined cases: a null text is the empty blob; copies of any number are scanned once and each gets
all findings; rows without id keep their findings; an empty table gives an empty result and
leaves the ledger as it is; a text without findings has an empty list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; others are passed
    over. Change ``version`` with the pattern."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which spans of equal start are listed. A run of
# 24 and more hexadecimal digits, or of AKIA and 16 more, is the same as a long enough whole run.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def running(values: Column, combine: Callable[[Column, Column], Column], nothing: int = 0) -> Column:
    """What ``combine`` makes of each prefix of an array of bigints; ``nothing`` must not matter to it.

    In each round every value takes in the one so many places before it, with twice as many places
    the next time, so that an array of n values takes n steps in each of log n rounds. Adding up an
    array value by value would copy what is there each time.
    """
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")

    def widen(done: Column, k: Column) -> Column:
        places = F.pow(F.lit(2), k).cast("int")
        moved = F.slice(F.concat(F.array_repeat(F.lit(nothing).cast("bigint"), places), done), F.lit(1), F.size(done))
        return F.zip_with(done, moved, combine)

    return F.aggregate(F.filter(F.sequence(F.lit(0), rounds), lambda k: k < rounds), values, widen)


def spans(text: Column, rule: Rule) -> Column:
    """The findings of one rule, leftmost first and without overlap."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("wholes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("kept"),
    )

    def add(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["wholes"])), p["wholes"], lambda g, w: (g + w).cast("bigint"))
        ends = running(steps, lambda a, b: a + b)
        return F.arrays_zip(ends.alias("end"), p["wholes"].alias("size"), p["kept"].alias("kept"))

    def located(x: Column) -> Column:
        end = x["end"]
        return F.struct(F.lit(rule.kind).alias("kind"), (end - x["size"]).alias("start"), end.alias("end"))

    # A transform over one element binds the parts to a name, so that each is made once.
    every = F.transform(F.array(parts), add)[0]
    found = F.transform(F.filter(every, lambda x: x["kept"] >= rule.least), located).cast(FOUND)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(FOUND))


def _known(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    return spark.read.schema(f"blob string, scanned array<string>, found {FOUND}").parquet(ledger)


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> int:
    """Bring the ledger up to date with all texts of ``docs``; the number of blobs scanned."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    blobs = (
        docs.select(F.sha2(whole, 256).alias("blob"), whole.alias("text"))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    every = F.array(*(F.lit(rule.key) for rule in rules))
    known = _known(spark, ledger)
    if known is None:
        pending = blobs.withColumn("pending", every)
    else:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        pending = blobs.join(done, "blob", "left").withColumn(
            "pending", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        )
    found = F.concat(
        *(
            F.when(F.array_contains("pending", rule.key), spans(F.col("text"), rule)).otherwise(
                F.array().cast(FOUND)
            )
            for rule in rules
        )
    )
    watched = Observation("scanned blobs")
    (
        pending.filter(F.size("pending") > 0)
        .select("blob", F.col("pending").alias("scanned"), found.alias("found"))
        .observe(watched, F.count(F.lit(1)).alias("blobs"))
        .write.mode("append")
        .parquet(ledger)
    )
    return int(watched.get["blobs"] or 0)


def findings(
    docs: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    into: str = "found",
) -> DataFrame:
    """``docs`` with a column ``into``: the findings of all given rules, by start and rule.

    A column of that name is replaced.
    """
    order = {rule.kind: k for k, rule in enumerate(rules)}
    place = F.create_map(*(x for kind, k in order.items() for x in (F.lit(kind), F.lit(k))))
    known = _known(docs.sparkSession, ledger)
    if known is None:
        return docs.withColumn(into, F.array().cast(FOUND))
    named = docs.drop(into).withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    # Only the current version of each rule counts. Blobs without findings need no join.
    current = [rule.key for rule in rules]
    rows = (
        known.filter(F.size("found") > 0)
        .select("blob", F.explode("scanned").alias("key"), "found")
        .filter(F.col("key").isin(current))
        .select("blob", "key", F.filter("found", lambda f: f["kind"] == F.substring_index("key", "@", 1)).alias("found"))
        .filter(F.size("found") > 0)
        .dropDuplicates(["blob", "key"])
    )

    def ranked(f: Column) -> Column:
        return F.struct(f["start"], place[f["kind"]].alias("rank"), f["end"], f["kind"])

    merged = rows.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found")).select(
        F.col("blob").alias("__blob"),
        F.transform(
            F.array_sort(F.transform("found", ranked)),
            lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")),
        ).alias(into),
    )
    joined = named.join(merged, "__blob", "left").drop("__blob")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(FOUND)))


def listed(found: Column) -> Column:
    """Findings as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(
            found,
            lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each finding, or run of overlapping ones, replaced by a mark.

    ``found`` must be ordered by start.
    """
    # With four bytes for each code point any piece is found at once; bound to a name, the text is
    # encoded once.
    def cut(data: Column, begin: Column, end: Column) -> Column:
        return F.decode(F.substring(data, (4 * begin + 1).cast("int"), (4 * (end - begin)).cast("int")), "UTF-32")

    def replace(p: Column) -> Column:
        reach = running(F.transform(p["found"], lambda f: f["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0).cast("bigint")), reach)
        data = p["data"]

        # The arrays made so far are bound as well, or every finding would make them again.
        def pieces(bound: Column) -> Column:
            parts = F.transform(
                p["found"],
                lambda f, k: F.when(
                    f["start"] >= F.get(bound, k), F.concat(cut(data, F.get(bound, k), f["start"]), F.lit(mark))
                ).otherwise(""),
            )
            rest = cut(data, F.element_at(bound, -1), F.lit(1 << 28).cast("bigint"))
            return F.concat(F.array_join(parts, ""), rest)

        return F.transform(F.array(before), pieces)[0]

    bound = F.array(F.struct(F.encode(text, "UTF-32").alias("data"), found.alias("found")))
    return F.when(F.size(found) > 0, F.transform(bound, replace)[0]).otherwise(text)
