"""Secret scans over a ledger of content-addressed blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. Only (blob, rule version) pairs that the
ledger doesn't have are scanned, each blob once however many paths share it, and findings are joined back to all
paths. A :class:`Ledger` keeps this between applications.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import BatchStore, free_name, materialize, once


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; one whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE_RULES = (
    SecretRule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    SecretRule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: The rules of an earlier version: without the last kind, and with long hexadecimal strings only.
EARLIER_RULES = (BASE_RULES[0], BASE_RULES[1], SecretRule("hex", "[0-9a-f]{40,}", version=0), *RULES[3:-1])

SPANS = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"
VERSIONS = "path string, blob string"
FINDINGS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _ends(lengths: Column) -> Column:
    """Running sums of an array of integers.

    Spark's folds copy the array that they append to, so the sums run in blocks of about the root of its size, and
    then over the blocks' totals.
    """
    none = F.array().cast("array<long>")

    def sums(of: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
        return F.aggregate(of, zero, step, lambda a: a["out"])

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: sums(F.slice(v, i * width + 1, width)))

    def joined(b: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(b, lambda x: F.element_at(x, -1))))
        return once(before, lambda s: F.flatten(F.transform(b, lambda x, i: once(F.get(s, i), lambda o: F.transform(x, lambda n: n + o)))))

    return once(lengths, lambda v: F.when(F.size(v) > 0, once(blocks(v), joined)).otherwise(none))


def spans(text: Column, rule: SecretRule) -> Column:
    """Code-point offsets, end exclusive, of a rule's matches, in order.

    The text splits into gaps around its matches, so a match ends at the length of all gaps and matches up to it.
    """
    none = F.array().cast(SPANS)

    def placed(p: Column) -> Column:
        """Of (gap, hit, held) the spans of hits that are long enough; what follows the last hit is no hit."""
        hits = F.filter(p, lambda x: x["hit"].isNotNull())
        ends = _ends(F.transform(hits, lambda x: (x["gap"] + x["hit"]).cast("long")))
        found = F.zip_with(hits, ends, lambda x, end: F.struct((end - x["hit"]).alias("start"), end.alias("end"), x["held"].alias("held")))
        return F.transform(F.filter(found, lambda x: x["held"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length).alias("hit"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("held"),
    )
    return F.when(text.rlike(rule.pattern), once(pieces, placed).cast(SPANS)).otherwise(none)


def address(text: Column) -> Column:
    """The content address of a text: SHA-256 of its UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, version, spans): one for each blob of ``versions`` and rule version not in ``ledger``.

    Spans are empty where a rule finds nothing, so that the pair isn't scanned again. Null texts count as empty ones;
    equal texts are scanned once; an empty table gives an empty result.
    """
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))  # copies combine before they meet the ledger
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))  # one entry a rule version
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.where(F.size(F.array_except(F.array(*(F.lit(r.key) for r in rules)), "seen")) > 0)
    fresh = [
        F.when(~F.array_contains("seen", r.key), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    rows = blobs.select("blob", F.explode(F.filter(F.array(*fresh), lambda x: x.isNotNull())).alias("r"))
    return rows.select("blob", "r.rule", "r.version", "r.spans")


def update_ledger(ledger: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The ledger with new rows; a pair that both have is kept once."""
    return fresh if ledger is None else ledger.unionByName(fresh.join(ledger, ["blob", "rule", "version"], "left_anti"))


def commit(ledger: DataFrame | None, versions: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger with a batch of versions scanned under ``rules``; what it had already is neither scanned nor written again."""
    return update_ledger(ledger, materialize(scan_unseen(versions, ledger, rules, text), "ledger"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text", into: str = "findings") -> DataFrame:
    """``versions`` with ``into``: array of (start, rank, kind, end) by start, then by the rules' order, of each version's blob.

    Every row of ``versions`` is kept, equal ones and those with a null text or path too. Only blobs with findings are
    joined. A column called ``into`` is replaced.
    """
    blob = free_name(versions, "blob")
    return _with_findings(versions.drop(into).withColumn(blob, address(F.col(text))), ledger, rules, blob, into).drop(blob)


def _with_findings(versions: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...], blob: str, into: str) -> DataFrame:
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    hits = ledger.where((F.size("spans") > 0) & F.concat_ws(":", "rule", "version").isin([r.key for r in rules]))
    rows = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.concat_ws(":", "rule", "version")).alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("f"))
    by_blob = rows.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias(into))  # a list a rule
    by_blob = materialize(by_blob, "by_blob")  # so that both sides of the join are shuffled, and a text of many paths can be split
    out = versions.join(by_blob.withColumnRenamed("blob", blob), blob, "left")
    return out.withColumn(into, F.coalesce(into, F.array().cast(FINDINGS)))


class Ledger(BatchStore):
    """A ledger of blobs in ``store``, which further commits and applications add to.

    A commit is written to folders of its own, and an empty file that is put below ``commits`` last makes it count. One
    that a crash has cut short is passed over and can be sent again; one that counts is passed over when it comes again.
    """

    def commits(self) -> list[str]:
        """Names of the commits that count, in their order."""
        return [n.split(".", 1)[1] for n in self._names("commits")]

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.store}/{table}/{n}" for n in self._names("commits")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """(blob, rule, version, spans), one row for each blob and rule version that has been scanned."""
        return self._read("scanned", LEDGER)

    def commit(self, name: str, versions: DataFrame, rules: tuple[SecretRule, ...] = RULES, path: str = "path", text: str = "text") -> bool:
        """Add the ``versions`` (path, text) of a commit, scanned under ``rules`` for what no commit has scanned; false if ``name`` counts already.

        Every row is kept as a version of its path, equal rows and null paths too; null texts are empty ones. Further
        columns are passed over. Names are letters, digits, ``_`` and ``-``. A second writer fails while one is at work.
        """
        if not re.fullmatch(r"[\w-]+", name, re.ASCII):
            raise ValueError(f"no name for a commit: {name!r}")
        with self._alone():
            had = self.commits()
            if name in had:
                return False
            at = f"{len(had):08d}.{name}"
            scan_unseen(versions, self.rows() if had else None, rules, text).write.mode("overwrite").parquet(f"{self.store}/scanned/{at}")
            kept = versions.select(F.col(path).cast("string").alias("path"), address(F.col(text)).alias("blob"))
            kept.write.mode("overwrite").parquet(f"{self.store}/versions/{at}")
            fs, marker = self._path(f"commits/{at}")
            fs.create(marker, False).close()
        return True

    def history(self, rules: tuple[SecretRule, ...] = RULES, into: str = "findings") -> DataFrame:
        """Every version of every path: ``commit``, ``place`` (the commit's number, from 0), ``path``, ``blob``, ``pending`` and the findings of ``rules``.

        ``pending`` names the rule versions that the blob hasn't been scanned under, ``kind:version``; findings have
        nothing of those, until a commit brings the text again.
        """
        parts = self._read("versions", VERSIONS).withColumn("__at", F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-2)))
        parts = parts.select(F.substring_index("__at", ".", -1).alias("commit"), F.substring_index("__at", ".", 1).cast("int").alias("place"), "path", "blob")
        rows = self.rows()
        done = rows.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("__done"))  # one entry a rule version
        every = F.array(*(F.lit(r.key) for r in rules))
        out = _with_findings(parts.join(done, "blob", "left"), rows, rules, "blob", into)
        return out.select("commit", "place", "path", "blob", F.array_except(every, F.coalesce("__done", F.array().cast("array<string>"))).alias("pending"), into)
