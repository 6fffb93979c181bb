"""Incremental secret scan over a ledger of content-addressed blobs.

Every historical version of every path is a blob, addressed by the SHA-256 of its text. The ledger is a Parquet
table with one row per blob and scan run, which says which rule versions were applied and where each of them matched.
A run groups the versions by address (combined on the map side, so that a text that a third of all rows hold
sends one row per task), drops the (blob, rule version) pairs that the ledger has, scans the rest once, appends
to the ledger, and joins the findings back to all paths. DataFrame functions only.

Defined results: a null text counts as empty; repeated rows each get their report; paths may be null; other
columns of the input, whatever their names, aren't read; an empty table gives an empty report and ledger.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import exists, shared_dir, stage, table, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` must have at least `least` characters; matches that fall short are dropped after matching, as they consume text."""

    name: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Runs of [0-9a-f] and AKIA[A-Z0-9]+ are maximal, so the counted forms match just the long enough ones.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob binary, rules array<string>, layout array<struct<rule:string,pos:int,gap:int,len:int,glen:int>>"


def _layout(rule: Rule):
    """A rule's matches in order: the length of the text since the last match, of the match, and of its group. Code points."""
    gaps = F.split("text", rule.pattern, -1)
    lens = lambda group: F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group)), F.length)
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), lens(0).alias("len"), lens(rule.group).alias("glen"))
    rows = F.transform(F.filter(rows, lambda x: x["len"].isNotNull()), lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"), x["glen"].alias("glen")))
    return rows


def addressed(paths: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return paths.select(*[paths[k] for k in keys], F.unhex(F.sha2(text_of(paths, text), 256)).alias("blob"))


def scan_new(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger at that path doesn't have, appends it, and returns the whole ledger."""
    spark = versions.sparkSession
    known = spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)
    done = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    blobs = versions.select(text_of(versions, text).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").withColumn("rules", todo).where(F.size("rules") > 0)
    none = F.array().cast("array<struct<rule:string,pos:int,gap:int,len:int,glen:int>>")
    found = [F.when(F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern), _layout(r)).otherwise(none) for r in rules]
    unseen.select("blob", "rules", F.concat(*found).cast("array<struct<rule:string,pos:int,gap:int,len:int,glen:int>>").alias("layout")).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule (its place in rules), start, end of every match that is long enough, of the given rule versions."""
    spans = ledger.where(F.size("layout") > 0).select("blob", F.explode("layout").alias("m")).select("blob", "m.*")
    key, least = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.least) for r in rules])
    # The ledger has the rule's key, as a rule's place is another one in each run.
    spans = spans.withColumn("rule", (F.array_position(key, F.col("rule")) - 1).cast("int")).where(F.col("rule") >= 0)
    so_far = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far))
    return spans.where(F.col("glen") >= F.get(least, F.col("rule"))).select("blob", "rule", (F.col("end") - F.col("len")).alias("start"), "end")


def scan(paths: DataFrame, keys: list[str], ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row per row of `paths`: its keys, counts by rule (n_<rule>) and `found`, an array of (start, rule, end) in order."""
    hits = findings(scan_new(paths, ledger, rules, text), rules)
    per_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end"))).alias("found"))
    # Staged, as a join of two fresh exchanges is one whose hot address Spark can split.
    per_blob = stage(per_blob, "secret-findings")
    out = addressed(paths, keys, text).join(per_blob, "blob", "left")
    of_rule = lambda i: F.filter("found", lambda x: x["rule"] == i)
    counts = [F.coalesce(F.size(of_rule(i)), F.lit(0)).cast("long").alias(f"n_{r.name}") for i, r in enumerate(rules)]
    return out.select(*keys, *counts, F.coalesce("found", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("found"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents, through a ledger of its own that begins empty."""
    out = scan(table(spark, sf_dir, "documents"), ["doc_id"], f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}")
    names = F.array(*[F.lit(r.name) for r in RULES])
    joined = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["rule"]), x["start"], x["end"])), ",")
    return out.withColumn("spans", joined).select("doc_id", *[f"n_{r.name}" for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans")


_KINDS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
OP1_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT r, {i} AS k, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS l, list_transform(regexp_extract_all(t, '{p}', {n}), lambda x: length(x)) AS q, {least} AS least FROM d WHERE regexp_matches(t, '{p.replace('+', '{' + str(least) + ',}') if n == 0 and i == 2 else p}')"
        for i, (_, p, n, least) in enumerate(_KINDS)
    )
    + """), e AS (SELECT r, k, unnest(range(1, len(l) + 1)) AS i, unnest(g[1:len(l)]) AS gap, unnest(l) AS len, unnest(q) AS q, least FROM m),
f AS (SELECT r, k, q, least, len, sum(gap + len) OVER (PARTITION BY r, k ORDER BY i) AS e FROM e),
s AS (SELECT r, k, (e - len)::BIGINT AS b, e::BIGINT AS e FROM f WHERE q >= least),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][k + 1] || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""
)
