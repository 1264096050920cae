"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds the pairs
(digest, rule_version) that were scanned and what was found in them; only other pairs
are scanned, once for each digest however many paths hold it, and findings, old and
new, are joined back to all paths.

A first pass over the texts works out the address and whether any rule can match (a
substring test for most rules); only texts in which one can are ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_crc32, scratch, stored, text_or_empty, unused

RULE_VERSION = "1"
MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Texts without any of these need no matching.
    needs: tuple[str, ...] = ()
    #: The least length of a group; a match whose group is shorter is dropped, but it
    #: still takes its characters.
    group: int = 0
    least: int = 0


#: The first three are the base kinds; kinds at one start are listed in this order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
    # up to the END line, or else the lines of a key that follow
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n\\-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t\r\n]*[A-Za-z0-9+/=]{40,})*+)",
        ("-----BEGIN",),
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",)),
)
BASE = 3


def _may_match(text: Column, rule: Rule) -> Column:
    found = F.lit(False)
    for s in rule.needs:
        found = found | F.contains(text, F.lit(s))
    return found if rule.needs else text.rlike(rule.pattern)


def may_hold(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule can match; false for a null text."""
    found = F.lit(False)
    for r in rules:
        found = found | _may_match(text, r)
    return F.coalesce(found, F.lit(False))


def _matches(text: Column, rule: Rule) -> Column:
    """Matches of a rule, left to right; null where there can be none."""
    return F.when(_may_match(text, rule), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))


def _holds(match: Column, rule: Rule) -> Column:
    return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)


def _held_by(rule: Rule):
    return lambda match: _holds(match, rule)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, text), one row a digest -> (digest, rank, kind, start, end): spans in
    code points.

    The text between matches (a split by the same pattern) and the matches alternate,
    so a running sum of their lengths over a blob's matches gives the places.
    """
    text = F.col("text")
    per_rule = [
        F.struct(
            F.lit(k).alias("rank"),
            F.when(
                F.size(_matches(text, r)) > 0,
                F.arrays_zip(
                    F.transform(_matches(text, r), F.length).alias("size"),
                    F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"),
                    F.transform(_matches(text, r), _held_by(r)).alias("holds"),
                ),
            ).alias("found"),
        )
        for k, r in enumerate(rules)
    ]
    each = blobs.select("digest", F.explode(F.array(*per_rule)).alias("x")).filter("x.found is not null")
    rows = each.select("digest", "x.rank", F.posexplode("x.found").alias("at", "m")).filter("m.size is not null")
    so_far = Window.partitionBy("digest", "rank").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return (
        rows.withColumn("end", end)
        .filter("m.holds")
        .select("digest", "rank", F.get(kinds, F.col("rank")).alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), "end")
    )


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text_or_empty(text.cast("string")), "UTF-8"), 256)


def versions(rows: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, digest, text) of each row; a null text counts as empty."""
    return rows.select(F.col(path).alias("path"), _digest(F.col(text)).alias("digest"), text_or_empty(F.col(text).cast("string")).alias("text"))


class Ledger:
    """Two tables in a folder that all executors share: ``seen`` (digest, rule_version)
    and ``findings`` (digest, rank, kind, start, end, rule_version).

    Findings are appended before the pairs they belong to, so a run that is lost in
    between scans its blobs again; what it found twice is read once.
    """

    SEEN = "digest string, rule_version string"
    FINDINGS = "digest string, rank int, kind string, start bigint, end bigint, rule_version string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        for table, schema in (("findings", self.FINDINGS), ("seen", self.SEEN)):
            columns = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))]
            self._append(table, spark.range(0).select(*columns))  # so that the folder is there

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def seen(self, rule_version: str) -> DataFrame:
        rows = self.spark.read.schema(self.SEEN).parquet(f"{self.path}/seen")
        return rows.filter(F.col("rule_version") == rule_version).select("digest")

    def findings(self, rule_version: str) -> DataFrame:
        rows = self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings")
        return rows.filter(F.col("rule_version") == rule_version).drop("rule_version").distinct()

    def add(self, findings: DataFrame, digests: DataFrame, rule_version: str) -> None:
        version = F.lit(rule_version).alias("rule_version")
        self._append("findings", findings.select("digest", F.col("rank").cast("int"), "kind", F.col("start").cast("bigint"), F.col("end").cast("bigint"), version))
        self._append("seen", digests.select("digest", version))


def find_new(rows: DataFrame, digests: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings, old and new, by digest: of the blobs of ``rows``, versions() with the
    addresses ``digests``, those that the ledger has not seen under these rules are scanned
    and added to it; all of them without a ledger."""
    texts = rows.filter(may_hold(F.col("text"), rules)).select("digest", "text").dropDuplicates(["digest"])
    if ledger is None:
        return cut(find(texts, rules))
    known = ledger.seen(rule_version)
    fresh = digests.select("digest").distinct().join(known, "digest", "left_anti")
    ledger.add(find(texts.join(known, "digest", "left_anti"), rules), fresh, rule_version)
    return ledger.findings(rule_version)


def scan(rows: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs of ``rows``, versions(), that the ledger has not seen under these
    rules, and add them to it. Without a ledger all blobs are scanned.

    Returns (paths, findings): path and digest of each row; findings, old and new, by
    digest. Rows repeated with one text are one blob, kept once on the map side, so a
    much-copied text is no hot key. The empty text is a blob as any.
    """
    paths = stored(rows.select("path", "digest"), "secret-paths")
    return paths, find_new(rows, paths, ledger, rules, rule_version)


def _joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def report(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each path row with its blob's counts and spans. Findings are grouped
    by digest and cut off first, so a much-copied blob meets one row over a plain
    exchange, whose partition Spark can split."""
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind")))
    count = lambda k: F.count(F.when(F.col("rank") == k, 1)).alias(f"n_{RULES[k].kind}")
    by_blob = findings.groupBy("digest").agg(*[count(k) for k in range(BASE)], spans.alias("found"))
    by_blob = by_blob.select(
        "digest", *[f"n_{r.kind}" for r in RULES[:BASE]], _joined(F.filter("found", lambda s: s["rank"] < BASE)).alias("base"), _joined(F.col("found")).alias("spans")
    )
    all_rows = paths.join(cut(by_blob), "digest", "left")
    return all_rows.select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in RULES[:BASE]],
        F.sha2(F.encode(F.coalesce("base", F.lit("")), "UTF-8"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs``.

    The history comes in two runs over one ledger: an earlier state of the table, which
    is about half of it, then all of it, of which only blobs not seen yet are scanned.
    Null and empty texts have no findings; rows repeated with one text, with equal,
    other or null ids, have the same; an empty table gives an empty result; other
    columns are ignored. A text of any length is one blob.
    """
    ledger = Ledger(docs.sparkSession, scratch(docs.sparkSession, "secret-ledger"))
    scan(versions(docs.filter(F.pmod(id_crc32(F.col("doc_id")), F.lit(2)) == 0)), ledger)
    return report(*scan(versions(docs), ledger))


def _masked(text: Column, rule: Rule) -> Column:
    between, found = F.split(text, rule.pattern, -1), _matches(text, rule)
    parts = F.zip_with(
        between,
        found,
        lambda a, m: F.concat(a, F.when(m.isNull(), F.lit("")).when(_holds(m, rule), F.lit(MASK)).otherwise(m)),
    )
    return F.when(_may_match(text, rule), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with a mask for each secret in the texts that have one; n_chars follows.

    Columns are unchanged, whatever their names, null texts stay null, and all rows stay,
    repeated ones too; a text of any length is masked whole, an empty table gives an empty
    result. Rows in whose text no rule can match are passed on as they are; the others meet
    the digests with findings. With a ledger only blobs that it has not seen are scanned.
    """
    rows = versions(docs)
    findings = find_new(rows, rows, ledger)
    key, bad = unused(docs, "digest", "found")
    hit = cut(findings.select(F.col("digest").alias(bad)).distinct())
    maybe = may_hold(F.col("text"))
    marked = docs.filter(maybe).withColumn(key, _digest(F.col("text")))
    marked = marked.join(hit, F.col(key) == F.col(bad), "left")
    text = F.col("text")
    for rule in (*RULES[BASE:], *RULES[:BASE]):  # a mask within a key would hide its end
        marked = marked.withColumn("text", F.when(F.col(bad).isNotNull(), _masked(text, rule)).otherwise(text))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(F.col(bad).isNotNull(), size).otherwise(F.col("n_chars")))
    return docs.filter(~maybe).unionByName(marked.select(*docs.columns))
