"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger, a table in a shared
folder, holds the (blob, rule at version) pairs that were scanned before and what they gave.  A scan
first addresses all versions in slim rows, compares them with the ledger, then reads the text of one
path for each blob that has an unseen pair, applies only the unseen rules and appends the result.
``scan_history`` does so for one snapshot after the other and joins the findings of the ledger back to
all paths of all snapshots.

The second reading picks its rows by the smaller side: the rows to leave out or the rows to take, sent
to all tasks up to a checked number; only beyond it are texts moved, each blob's once.

Spans: ``split`` gives the texts between the matches and ``regexp_extract_all`` the matches, in order;
the running sum of their lengths (code points) places each match.  The sums run over exploded rows of
one blob and rule, so their cost follows the matches.

Cases: a null text is empty; very long texts are scanned whole; rows that repeat an id are separate
versions, of one blob if the texts are equal; null ids are paths like others; spans that start at the
same place are listed in the order of the rules; a blob without findings has an empty span list; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, whole_text
from corvane.plans.scratch import materialize, release, scratch_root


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base rules in the order in which ties are listed, then the ledger's own.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]++", 0, 20),
    # the same as runs of any length of which those of 24 or more stay, without the short ones
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
RULES = (*BASE_RULES, Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"))

_SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _parts(text: Column, rule: Rule, order: int, unseen: Column) -> Column:
    """One struct per match: the text length before it and its own, whether it stays; else an empty array."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(matches, lambda x: F.length(x)).alias("size"),
        F.transform(kept, lambda x: F.length(x) >= rule.least).alias("good"),
    )
    found = F.transform(
        F.filter(zipped, lambda z: z["size"].isNotNull()),
        lambda z, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), z["good"].alias("good")),
    )
    none = F.array().cast("array<struct<ord:int,i:int,gap:int,size:int,good:boolean>>")
    return F.when(F.array_contains(unseen, rule.key) & F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, unseen, spans) from (blob, text, unseen), ``unseen`` listing the keys of the rules to apply."""
    text, unseen = F.col("text"), F.col("unseen")
    parts = F.concat(*(_parts(text, r, n, unseen) for n, r in enumerate(rules)))
    # rows are told apart by a number, as a blob may come twice
    scanned = materialize(blobs.select("blob", "unseen", parts.alias("parts"), F.monotonically_increasing_id().alias("uid")), "scan")
    rows = scanned.where(F.size("parts") > 0).select("uid", F.inline("parts"))
    upto = Window.partitionBy("uid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    names = F.array(*(F.lit(r.name) for r in rules))
    spans = (
        rows.withColumn("end", end)
        .where("good")
        .select("uid", F.struct((F.col("end") - F.col("size")).alias("start"), "ord", names[F.col("ord")].alias("kind"), "end").alias("s"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list("s")).alias("spans"))
    )
    return scanned.select("uid", "blob", "unseen").join(spans, "uid", "left").select("blob", "unseen", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def _address(versions: DataFrame, path: str) -> DataFrame:
    keyed = versions.select(F.col(path).alias("path"), whole_text().alias("text"))
    return keyed.select("path", F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def _unseen_texts(keyed: DataFrame, paths: DataFrame, todo: DataFrame) -> DataFrame:
    """(blob, text, unseen) of the rows that ``todo`` (blob, one, unseen) names; a repeated row may come twice."""
    same = F.col("blob").eqNullSafe(F.col("b")) & F.col("path").eqNullSafe(F.col("one"))
    todo = todo.select(F.col("blob").alias("b"), "one", "unseen")
    skip = materialize(paths.join(todo, same, "left_anti").distinct().select(F.col("blob").alias("b"), F.col("path").alias("one")), "skip")
    kinds = todo.select("unseen").distinct().limit(2).collect()
    n_todo, n_skip = todo.count(), skip.count()
    if len(kinds) == 1 and n_skip <= min(n_todo, BROADCAST_ROWS):
        # everything but a few rows, all for the same rules
        texts = keyed.join(F.broadcast(skip), same, "left_anti").withColumn("unseen", F.array(*map(F.lit, kinds[0].unseen)))
    elif n_todo <= BROADCAST_ROWS:
        texts = keyed.join(F.broadcast(todo), same)
    else:
        texts = keyed.join(todo.hint("shuffle_hash"), same)
    return texts.select("blob", "text", "unseen")


def scan(versions: DataFrame, path: str = "doc_id", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """((path, blob) of all versions, new ledger rows).

    ``ledger`` has the rows (blob, unseen, spans) of earlier scans: ``unseen`` as it was then, so the
    union over a blob's rows is what has been scanned.  The new rows are to be appended to it.
    """
    keyed = _address(versions, path)
    paths = materialize(keyed.select("path", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("one"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("unseen", wanted)
    else:
        seen = ledger.select("blob", F.explode("unseen").alias("k")).groupBy("blob").agg(F.collect_set("k").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("unseen", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = materialize(todo.where(F.size("unseen") > 0).select("blob", "one", "unseen"), "todo")
    # rows that repeat a path and a text are one blob; what was found in them is the same
    new = scan_blobs(_unseen_texts(keyed, paths, todo), rules).dropDuplicates(["blob"])
    return paths, materialize(new, "unseen")


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """(path, blob, spans) of each version: what the ledger has for its blob by ``rules``."""
    # spans of a rule's other versions are left out
    keys = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.key)))
    current = F.filter("spans", lambda s: F.array_contains("unseen", F.element_at(keys, s["kind"])))
    entries = ledger.select("blob", current.alias("spans")).where(F.size("spans") > 0)
    entries = entries.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = paths.join(entries, "blob", "left")
    return found.select(F.col("path").alias(path), F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


class Ledger:
    """The ledger's table in a folder that all executors share; each scan appends its rows."""

    SCHEMA = f"blob binary, unseen array<string>, spans {_SPAN}"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{scratch_root(spark)}/corvane/ledger-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)

    def rows(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)


def scan_history(snapshots: list[DataFrame], ledger: Ledger, path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) of every version in ``snapshots``, oldest first; the ledger grows by each."""
    every: DataFrame | None = None
    for snapshot in snapshots:
        paths, new = scan(snapshot, path, ledger.rows(), rules)
        ledger.append(new)
        release(new)
        every = paths if every is None else every.unionByName(paths)
    return findings(every, ledger.rows(), rules, path)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The digest columns of findings by ``doc_id``."""
    names = [r.name for r in base]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    own = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(
        "doc_id",
        *map(of, names),
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "blob",
    )
