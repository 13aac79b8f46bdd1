"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Texts are content-addressed: every version of every path maps to the SHA-256 of its bytes. The ledger says which
(blob, rule-version) pairs are scanned and what each rule version found. A scan takes the distinct hashes, leaves out the
pairs that the ledger has, runs the remaining rules on one text of each remaining blob, adds the outcome to the ledger
and joins findings of the rule versions asked for back to all paths. Only hashes are shuffled before a ledger has its
say, so a scan with nothing new moves no text. ``scan_into`` keeps the ledger as a Parquet table that is appended to.

Positions without a UDF: the matches of a rule and the pieces between them (split by the same rule) alternate, so a
match starts at the summed length of all before it. Only blobs with a match are exploded and summed, by a window over
one blob and rule. Copies of a blob meet in the map-side part of an aggregate, so a blob that a third of all rows hold
sends one hash a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Rule:
    """kind, version, pattern; a match counts if its group has min_length characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_length: int = 0

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans of one start are listed. For access and hex the least length is in the pattern: a run
#: that is too short holds no longer one.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
ADDED_RULES = (
    Rule(
        "provider", 1,
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,255}"
        r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    ),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
HELD = "array<struct<start:int,rule:string,end:int>>"
#: rules are the tags "kind@version" run on a blob, spans what each of them found.
LEDGER_SCHEMA = f"blob string, rules array<string>, spans {HELD}"
#: Unseen blobs are broadcast up to this many (some 30 MB); beyond, texts are shuffled to them.
BROADCAST_ROWS = 200_000


def blob_of(text):
    return F.sha2(text, 256)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_fl_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_fl_text"))


def _tags(rules):
    return F.array(*[F.lit(r.tag) for r in rules])


def unseen(docs: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, _fl_first, rules) of the blobs that the ledger lacks under some of rules: the least id of one, the tags to run."""
    own = _texts(docs, id_col, text_col)
    blobs = own.select(blob_of(F.col("_fl_text")).alias("blob"), "_fl_id").groupBy("blob").agg(F.min("_fl_id").alias("_fl_first"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("_fl_seen"))
    blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(_tags(rules), F.coalesce("_fl_seen", F.array().cast("array<string>"))))
    return blobs.where(F.size("rules") > 0).drop("_fl_seen")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans) for the blobs of docs that the ledger lacks, or lacks under some rule version.

    Without a ledger every blob is unseen, and copies meet by their texts in one read.
    """
    own = _texts(docs, id_col, text_col).withColumn("_fl_blob", blob_of(F.col("_fl_text")))
    if ledger is None:
        blobs = own.select(F.col("_fl_blob").alias("blob"), "_fl_text").distinct().withColumn("rules", _tags(rules))
    else:
        todo = checkpointed(unseen(docs, ledger, rules, id_col, text_col))
        if todo.count() <= BROADCAST_ROWS:
            todo = F.broadcast(todo)
        blobs = own.join(todo, (F.col("_fl_blob") == F.col("blob")) & F.col("_fl_id").eqNullSafe(F.col("_fl_first"))).select("blob", "rules", "_fl_text")
    hits = blobs.withColumns({f"_fl_m{i}": F.when(F.array_contains("rules", r.tag), F.regexp_extract_all("_fl_text", F.lit(r.pattern), F.lit(0))) for i, r in enumerate(rules)})

    def measured(i: int, r: Rule):
        found = F.col(f"_fl_m{i}")
        ok = F.transform(F.regexp_extract_all("_fl_text", F.lit(r.pattern), F.lit(r.group)), lambda x: F.length(x) >= r.min_length) if r.min_length else F.transform(found, lambda x: F.lit(True))
        return F.when(
            F.size(found) > 0,
            F.struct(F.lit(r.tag).alias("rule"), F.arrays_zip(F.transform(F.split("_fl_text", r.pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("len"), ok.alias("ok")).alias("at")),
        )

    hits = hits.select("blob", "rules", F.filter(F.array(*[measured(i, r) for i, r in enumerate(rules)]), lambda x: x.isNotNull()).alias("_fl_hits"))
    if ledger is not None:  # a row may repeat an id and its text
        hits = hits.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("_fl_hits").alias("_fl_hits"))
    kept = checkpointed(hits)
    each = kept.where(F.size("_fl_hits") > 0).select("blob", F.explode("_fl_hits").alias("h")).select("blob", "h.rule", F.posexplode("h.at").alias("pos", "at"))
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("at.gap") + F.coalesce("at.len", F.lit(0))).over(upto).cast("int")).where("at.ok")
    spans = placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("at.len")).cast("int").alias("start"), "rule", "end"))).alias("spans"))
    return kept.select("blob", "rules").join(spans, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array().cast(HELD)).alias("spans"))


def written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, blob, spans of the given rule versions from the ledger, by start and rule."""
    tags = _tags(rules)
    held = ledger.where(F.exists("spans", lambda s: F.array_contains(tags, s.rule))).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = lambda s: F.struct(s.start.alias("start"), (F.array_position(tags, s.rule) - 1).cast("int").alias("rank"), F.substring_index(s.rule, "@", 1).alias("kind"), s.end.alias("end"))
    held = held.select("blob", F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: F.array_contains(tags, s.rule)), ranked))).alias("spans"))
    held = checkpointed(held)  # so that AQE can split the join where a third of all paths hold one blob
    paths = _texts(docs, id_col, text_col).select("_fl_id", blob_of(F.col("_fl_text")).alias("blob"))
    return paths.join(held, "blob", "left").select(F.col("_fl_id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger after this scan).

    Null texts count as empty and have no spans. Copies share one ledger row; repeated ids give repeated rows; an empty
    table gives no rows; columns other than id and text are ignored.
    """
    new = checkpointed(scan_unseen(docs, ledger, rules, id_col, text_col))
    after = new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)
    return findings(docs, after, rules, id_col, text_col), after


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger written at path, None if there is none yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_into(docs: DataFrame, path: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every path, as of scan, against the ledger at path (any store that Spark writes), which gets the new rows."""
    ledger = read_ledger(docs.sparkSession, path)
    new = checkpointed(scan_unseen(docs, ledger, rules, id_col, text_col))
    new.write.mode("append").parquet(path)
    return findings(docs, new if ledger is None else ledger.unionByName(new), rules, id_col, text_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in BASE_RULES]))
    return found.select(
        id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
