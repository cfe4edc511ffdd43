"""Secret scans with an incremental blob ledger.

Every version of every file is a blob, addressed by the SHA-256 of its text.  The ledger holds the
pairs of blob and rule version that were scanned, and the findings of each.  A scan reads only the
texts of blobs with an unseen pair, one copy of each, under the unseen rules alone; findings are then
joined to all paths and versions that have the blob.  A rule whose pattern changes gets a new
version number and is so scanned again everywhere.

All of it is JVM-side; a rule's regular expression runs only over texts that contain one of its
literal anchors, without which it can't match.  Texts without any anchor never leave their task: what
moves is the hashes of all texts, and the texts that may have a finding.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh_path, require, stored


class Rule(NamedTuple):
    name: str
    version: int
    anchors: tuple[str, ...]
    pattern: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


RULES = (
    Rule("aws-key", 1, ("AKIA", "ASIA"), "(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Rule("password", 2, ("assw", "ASSW", "pwd", "PWD"), "(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|pwd|PWD)[\"']?[ \\t]*[:=][ \\t]*[\"']?[^ \\t\\r\\n\\f\"']{8,}"),
    Rule("token", 2, ("oken", "OKEN", "ecret", "ECRET", "pi_key", "pi-key", "pikey", "pi_Key", "pi-Key", "piKey", "API_KEY", "API-KEY", "APIKEY"), "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[0-9A-Za-z_-]*[\"']?[ \\t]*[:=][ \\t]*[\"']?[0-9A-Za-z_+/=-]{16,}"),
    Rule("github", 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[0-9A-Za-z]{36}"),
    Rule("slack", 1, ("xox",), "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", 1, ("sk_live_",), "sk_live_[0-9A-Za-z]{16,}"),
    Rule("google", 1, ("AIza",), "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", 1, ("eyJ",), "eyJ[0-9A-Za-z_-]{8,}\\.[0-9A-Za-z_-]{8,}\\.[0-9A-Za-z_-]{8,}"),
    Rule("private-key", 1, ("PRIVATE KEY",), "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url-password", 1, ("://",), "[a-z][a-z0-9+]*://[^ \\t\\r\\n\\f:/@]+:[^ \\t\\r\\n\\f:/@]+@"),
)

#: The rules as they were: the first update of the registered query's ledger runs under these.
PAST = tuple(
    r._replace(version=1, pattern=p) if (p := {
        "password": "(?:[Pp]assword|PASSWORD|[Pp]asswd|pwd)[ \\t]*[:=][ \\t]*[\"']?[^ \\t\\r\\n\\f\"']{8,}",
        "token": "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?key|API_KEY)[ \\t]*[:=][ \\t]*[\"']?[0-9A-Za-z_+/=-]{16,}",
    }.get(r.name)) else r
    for r in RULES
)

PAIRS = "blob string, rule string, rule_version int"
FINDINGS = "blob string, rule string, rule_version int, match_no int, secret_sha256 string, length int"


def _may(anchors, text: Column) -> Column:
    may = F.lit(False)
    for anchor in dict.fromkeys(anchors):
        may = may | text.contains(anchor)
    return may


def _matches(rule: Rule, text: Column, todo: Column) -> Column:
    found = F.when(F.array_contains(todo, rule.key) & _may(rule.anchors, text), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"), found.alias("matches"))


def scan(history: DataFrame, pairs: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New pairs, new findings and ``(path, version, blob)`` of a history of ``(path, version, content)``.

    NULL contents are no blobs; an empty one is.  NULL paths and versions are kept.  Repeated rows
    give their findings once to the blob, and the path as often as it is there.  Contents of any length
    are scanned whole; an empty history gives empty results; other columns are ignored, whatever their names.
    """
    require(history, "path", "version", "content")
    known = [r.key for r in rules]
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules must have distinct names")
    path, version, content = (col(history, c) for c in ("path", "version", "content"))
    base = history.select(path.alias("path"), version.alias("version"), content.cast("string").alias("content")).where("content IS NOT NULL")
    at = stored(base.select("path", "version", F.sha2("content", 256).alias("blob")), "secrets-paths")
    new = at.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("one"))
    if pairs is not None:
        seen = pairs.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
        new = new.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, known)), F.coalesce("seen", F.array().cast("array<string>"))))
        new = new.where("size(todo) > 0")
    else:
        new = new.withColumn("todo", F.array(*map(F.lit, known)))
    new = stored(new.select("blob", F.col("one.path").alias("p"), F.col("one.version").alias("v"), "todo"), "secrets-new")
    some = base.where(_may([a for r in rules for a in r.anchors], F.col("content"))).withColumn("blob", F.sha2("content", 256))
    texts = some.join(new, (some["blob"] == new["blob"]) & some["path"].eqNullSafe(new["p"]) & some["version"].eqNullSafe(new["v"])).select(some["blob"], "content", "todo")
    per_rule = F.array(*[_matches(r, F.col("content"), F.col("todo")) for r in rules])
    hits = (
        texts.select("blob", F.filter(per_rule, lambda x: F.size(x["matches"]) > 0).alias("hits")).where("size(hits) > 0")
        .select("blob", F.explode("hits").alias("hit"))
        .select("blob", "hit.rule", "hit.rule_version", F.posexplode("hit.matches").alias("match_no", "secret"))
        .select("blob", "rule", "rule_version", "match_no", F.sha2("secret", 256).alias("secret_sha256"), F.length("secret").alias("length"))
        .distinct()
    )
    done = new.select("blob", F.explode("todo").alias("key")).select("blob", F.substring_index("key", "@", 1).alias("rule"), F.substring_index("key", "@", -1).cast("int").alias("rule_version"))
    return done, hits, at


def on_paths(findings: DataFrame, at: DataFrame) -> DataFrame:
    """Each finding at every path and version with its blob."""
    return at.join(findings, "blob").select("path", "version", "blob", "rule", "rule_version", "match_no", "secret_sha256", "length")


class Ledger:
    """A ledger in a folder that all executors share: Parquet tables ``pairs`` and ``findings``, only ever added to.

    Findings are written before the pairs that vouch for them: after a crash in between, the next
    scan repeats them, and reading takes each once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("pairs", PAIRS), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def pairs(self) -> DataFrame:
        return self.spark.read.schema(PAIRS).parquet(f"{self.path}/pairs").distinct()

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").distinct()

    def update(self, history: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen and give the findings of these rule versions at all paths of ``history``."""
        done, hits, at = scan(history, self.pairs(), rules)
        hits.write.mode("append").parquet(f"{self.path}/findings")
        done.write.mode("append").parquet(f"{self.path}/pairs")
        now = self.spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
        return on_paths(self.findings().join(F.broadcast(now), ["rule", "rule_version"], "left_semi"), at)


def document_history(docs: DataFrame) -> DataFrame:
    """Documents as versions of files: those of a source whose ids agree but for the last two bits are one file's; the version is the id."""
    return docs.select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 4).cast("long")).alias("path"), F.col("doc_id").cast("long").alias("version"), F.col("text").alias("content"))


def document_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, blob, rule, rule_version, match_no, secret_sha256, length)`` over all of ``documents``, by a fresh ledger.

    The ledger is updated twice, under past versions of the rules and then under the present ones; the second update
    scans the texts under the rules that have changed only, and takes the findings of the others from the ledger.
    """
    ledger, history = Ledger(docs.sparkSession, fresh_path(docs.sparkSession, "ledger")), document_history(docs)
    ledger.update(history, PAST)
    return ledger.update(history, RULES).withColumnRenamed("version", "doc_id")


def _rule_sql(r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"SELECT doc_id, source, text, '{r.name}' AS rule, {r.version} AS rule_version, regexp_extract_all(text, '{pattern}') AS m FROM documents"


ORACLE_SQL = f"""
WITH found AS ({" UNION ALL ".join(map(_rule_sql, RULES))}), each AS (
  SELECT doc_id, source, text, rule, rule_version, unnest(m) AS secret, unnest(range(len(m)))::INTEGER AS match_no FROM found WHERE len(m) > 0
)
SELECT doc_id, concat_ws('/', source, floor(doc_id / 4)::BIGINT) AS path, sha256(text) AS blob, rule, rule_version, match_no, sha256(secret) AS secret_sha256, length(secret)::INTEGER AS length FROM each
"""
