"""The rule store: tables in a shared folder, read and replaced together.

Data folders are written once and never changed. A commit is a small file that names the folders of every table; commits are
numbered, and a commit is made by renaming a finished file to the next number, which fails where another writer was first. Readers
take the last commit, so that rules, their evidence and verdicts always belong together, a writer that is lost halfway
leaves what was there, and older commits can be read as well. Rules and evidence lie in parts by corpus: a run rewrites its
own corpus only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import CONDITION
from ..operators.store import merge
from ..reuse import written
from ..schema import Thresholds
from .sinks import MANIFEST, SCHEMA_VERSION

KEY = ["id", "corpus", "scope"]
RULES = (
    f"id string, corpus string, scope string, pattern string, window string, subject string, guards array<string>, slot string, conditions array<{CONDITION}>, text string, predicate string, evidence string, "
    "verdict string, holds long, of long, corpus_holds long, corpus_of long, outcome_holds long, outcome_of long, status string, suppressed_by string, retired_reason string, reproposed_reason string, parent_id string, run string"
)
TABLES = {
    "rules": RULES,
    "evidence": "id string, corpus string, scope string, interaction string, episode string, seq int, holds boolean",
    "contradictions": "run string, scope string, rule_a string, rule_b string, reason string",
    "adjudications": "id string, corpus string, scope string, at timestamp, verdict string, note string, holds long, of long, reviewer string",
    "runs": MANIFEST,
    "decisions": "request string, operator string, verdict string, why string, observer string, observations string",
}
#: Tables in parts by corpus; the others only grow.
BY_CORPUS = ("rules", "evidence")
NOTE = f"note string, condition {CONDITION}"


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


@dataclass(frozen=True)
class Snapshot:
    """What a commit says: its number (0: nothing yet), the version of the tables' shape, and each table's schema and folders by part."""

    number: int = 0
    version: int = SCHEMA_VERSION
    tables: dict[str, dict] = field(default_factory=dict)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        """Of all commits, in order."""
        folder = self._path(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The last commit, or that of a number."""
        found = self.numbers()
        if not found and number is None:
            return Snapshot()
        at = found[-1] if number is None else number
        stream = self.fs.open(self._path(f"{self.folder}/commits/{at:012d}.json"))
        try:
            said = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(at, said["version"], said["tables"])

    def table(self, name: str, snapshot: Snapshot | None = None, part: str | None = None) -> DataFrame:
        """A table as of a commit, of one part or of all; of a commit of this version with all its columns."""
        at = snapshot or self.snapshot()
        known = at.tables.get(name)
        schema = T.StructType.fromJson(known["schema"]) if known else schema_of(TABLES[name])
        folders = [f for p, own in (known or {"parts": {}})["parts"].items() if part is None or p == part for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema_of(TABLES[name]) if at.version == SCHEMA_VERSION else schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{f}" for f in folders))
        return shaped(rows, name) if at.version == SCHEMA_VERSION else rows

    def commit(self, base: Snapshot, changes: list[tuple[str, str, DataFrame, bool]], version: int | None = None) -> Snapshot:
        """A new commit on top of base. changes: table, part, rows, and whether they replace the part's rows or are added to them."""
        tables = json.loads(json.dumps(base.tables))
        for name, part, rows, replaces in changes:
            folder = f"{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/data/{folder}")
            own = tables.setdefault(name, {"parts": {}})
            own["schema"] = rows.schema.jsonValue()
            own["parts"][part] = [folder] if replaces else [*own["parts"].get(part, []), folder]
        made = Snapshot(base.number + 1, version or base.version, tables)
        draft, final = (self._path(f"{self.folder}/commits/{n}") for n in (f".{uuid.uuid4().hex}", f"{made.number:012d}.json"))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": made.version, "tables": tables}).encode()))
        out.close()
        fs = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").NONE  # an existing commit stays
        try:
            fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.conf).rename(draft, final, options)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"commit {made.number} is another writer's") from error
            raise
        return made

    def vacuum(self, keep: int = 1) -> int:
        """Removes data that none of the last `keep` commits names, and older commits; the number of folders removed. Not while others write."""
        numbers = self.numbers()
        kept = numbers[-keep:]
        named = {f for n in kept for t in self.snapshot(n).tables.values() for own in t["parts"].values() for f in own}
        gone = 0
        for name in TABLES:
            folder = self._path(f"{self.folder}/data/{name}")
            for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                if f"{name}/{status.getPath().getName()}" not in named:
                    gone += self.fs.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"{self.folder}/commits/{n:012d}.json"), False)
        return gone


# --- versions of the tables' shape


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with null columns of these types, where they have none."""
    return rows.withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items() if n not in rows.columns})


def _keyed(rows: DataFrame, rules: DataFrame, key: list[str], more: str) -> DataFrame:
    """rows with `more`, a column of the rule with their key; rows of no rule go."""
    return rows.drop(more).join(rules.select(*key, more).dropDuplicates(key), key)


def _figures_and_reasons(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    rules = t["rules"].withColumns({"corpus_holds": F.col("holds"), "corpus_of": F.col("of"), "evidence": F.lit("")})
    return {"rules": _with(rules, parent_id="string", reproposed_reason="string", retired_reason="string"), "contradictions": t["contradictions"]}


def _rows_by_scope(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: _keyed(t[n], t["rules"], ["id"], "scope") for n in ("adjudications", "evidence")}


def _outcomes(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"rules": _with(t["rules"], outcome_holds="long", outcome_of="long"), "decisions": t["decisions"].select("request", "operator", "verdict", "why")}


def _rows_by_corpus(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: _keyed(t[n], t["rules"], ["id", "scope"], "corpus") for n in ("adjudications", "evidence")}


def _contradictions_by_scope(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    own = t["rules"].select(F.col("id").alias("rule_a"), "scope")
    return {"contradictions": t["contradictions"].drop("scope").join(own.dropDuplicates(), "rule_a")}


def _observers(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"decisions": _with(t["decisions"], observer="string", observations="string")}


#: From each version of the tables' shape to the next.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {
    1: _figures_and_reasons, 2: _rows_by_scope, 3: _outcomes, 4: _rows_by_corpus, 5: _contradictions_by_scope, 6: _observers,
}


def open_rules(spark: SparkSession, folder: str) -> Store:
    """The store in a folder. One of an older version is brought up to this one's, a commit a step, so that a lost run goes on where it was; one of a newer version is refused."""
    store = Store(spark, folder)
    at = store.snapshot()
    if at.version > SCHEMA_VERSION:
        raise ValueError(f"the store has version {at.version}, this engine knows {SCHEMA_VERSION}")
    while at.version < SCHEMA_VERSION:
        changes = []
        for name, rows in MIGRATIONS[at.version]({n: store.table(n, at) for n in TABLES}).items():
            if at.version + 1 == SCHEMA_VERSION or name not in at.tables or name not in BY_CORPUS:
                changes.append((name, "", rows, True))
                continue
            changes += [(name, part, rows.where(F.col("corpus") == part) if part else rows, True) for part in at.tables[name]["parts"]]
        at = store.commit(at, changes, at.version + 1)
    return store


# --- what runs and people do


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """rows with the columns of a table, those that are missing null."""
    schema = schema_of(TABLES[name])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def mined_rows(mined: DataFrame, corpus: str) -> DataFrame:
    """What plans.mine.mine gives as rows of the store: a rule's scope is its operator."""
    return shaped(mined.drop("scope").withColumns({"corpus": F.lit(corpus), "scope": F.col("operator")}), "rules")


def persist_mined(store: Store, corpus: str, run: str, mined: DataFrame, evidence: DataFrame | None = None, contradictions: DataFrame | None = None, manifest: dict | None = None, t: Thresholds = Thresholds()) -> dict[str, int]:
    """Merges a run's rules (RULES; missing columns are null) of a corpus into the store, with its evidence and contradictions, in one commit.

    operators.store.merge says what becomes of stored rules. A merged rule keeps its parent, and has the run's words, figures
    and evidence; one that wasn't mined keeps its own. Returns how many rules were inserted, updated, kept, reproposed, retired, removed, untouched.
    """
    base = store.snapshot()
    old = store.table("rules", base, corpus)
    new = written(shaped(mined.withColumn("corpus", F.lit(corpus)), "rules"))
    reasons = old.withColumn("reason", F.coalesce("retired_reason", "reproposed_reason"))
    decided = written(merge(reasons, new, run, t).select(*KEY, "status", "reason", "change"))
    names = [c for c in new.columns if c not in KEY]
    both = decided.join(old.select(*KEY, F.struct(*names).alias("old")), KEY, "left").join(new.select(*KEY, F.struct(*names).alias("new")), KEY, "left")
    change, fresh = F.col("change"), F.col("new.run").isNotNull() | F.col("new.status").isNotNull()
    own = {c: F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in names}
    own |= {
        "status": F.col("status"), "parent_id": F.coalesce("old.parent_id", "new.parent_id"),
        "retired_reason": F.when(change == "retired", F.col("reason")).when(F.col("status") == "retired", F.col("old.retired_reason")),
        "reproposed_reason": F.when(change == "reproposed", F.col("reason")),
        "run": F.when(fresh | (change == "retired"), F.lit(run)).otherwise(F.col("old.run")),
    }
    stays = both.where(change != "removed")
    rows = written(stays.select(*KEY, *(own[c].alias(c) for c in names)).select(*new.columns))
    proof = store.table("evidence", base, corpus).join(new.select(*KEY), KEY, "left_anti").join(rows.select(*KEY), KEY, "left_semi")
    if evidence is not None:
        given = shaped(evidence.withColumn("corpus", F.lit(corpus)), "evidence").dropDuplicates()
        proof = proof.unionByName(given.join(new.select(*KEY), KEY, "left_semi"))
    changes = [("rules", corpus, rows, True), ("evidence", corpus, shaped(proof, "evidence"), True)]
    if contradictions is not None:
        against = shaped(contradictions.withColumn("run", F.lit(run)), "contradictions").dropDuplicates(["run", "scope", "rule_a", "rule_b"])
        changes.append(("contradictions", "", against.join(store.table("contradictions", base), ["run", "scope", "rule_a", "rule_b"], "left_anti").select(against.columns), False))
    row = {"run": run, "corpus": corpus, "thresholds": json.dumps(vars(t), sort_keys=True)} | (manifest or {})
    fields = schema_of(MANIFEST)
    changes.append(("runs", "", store.spark.createDataFrame([tuple(row.get(f.name) for f in fields)], fields).withColumn("at", F.coalesce("at", F.current_timestamp())), False))
    store.commit(base, changes)
    return {r["change"]: r["count"] for r in decided.groupBy("change").count().collect()}  # seven at most


VERDICTS = ("real", "not_real", "narrowed")


def record_verdicts(store: Store, verdicts: DataFrame, calibrated: list[str] = ()) -> None:
    """People's verdicts (id, corpus, scope, verdict, note, fact, value, reviewer, at) in one commit: all are recorded, or none.

    corpus and scope may be null where the id's rule is the only one. `narrowed` needs a condition, fact and value. Neither it nor `real` is
    possible where a condition is on an observed fact (obs.*) that no predicate of `calibrated` gives. A rule gets the status of
    its last verdict; each is kept with the rule's figures as they were.
    """
    base = store.snapshot()
    rules = store.table("rules", base)
    said = written(verdicts.withColumn("number", F.monotonically_increasing_id()))
    met = said.select(F.col("id").alias("of_id"), F.col("corpus").alias("of_corpus"), F.col("scope").alias("of_scope"), "verdict", "note", "fact", "value", "reviewer", "at", "number")
    here = (F.col("id") == F.col("of_id")) & (F.col("of_corpus").isNull() | (F.col("of_corpus") == F.col("corpus"))) & (F.col("of_scope").isNull() | (F.col("of_scope") == F.col("scope")))
    met = written(rules.select(*KEY, "holds", "of", "conditions").join(met, here).drop("of_id", "of_corpus", "of_scope"))
    rows = met.groupBy("number").agg(F.count("*").alias("rules"))
    wrong = said.join(rows, "number", "left").where("coalesce(rules, 0) <> 1").select("id", F.coalesce("rules", F.lit(0)).alias("rules"))
    if bad := wrong.head(1):
        raise ValueError(f"{bad[0]['rules']} rules have the id {bad[0]['id']}, corpus and scope that a verdict names")
    facts = F.transform("conditions", lambda c: c["fact"])
    facts = F.filter(F.concat(F.coalesce(facts, F.array().cast("array<string>")), F.array("fact")), lambda f: f.startswith("obs."))
    blind = F.col("verdict").isin("real", "narrowed") & (F.size(F.array_except(facts, F.array(*map(F.lit, calibrated)).cast("array<string>"))) > 0)
    fault = F.when(~F.col("verdict").isin(*VERDICTS), "no such verdict").when((F.col("verdict") == "narrowed") & F.col("fact").isNull(), "narrowed needs a condition").when(blind, "an observed fact has no calibrated predicate")
    if bad := met.withColumn("fault", fault).where("fault is not null").head(1):
        raise ValueError(f"{bad[0]['id']} at {bad[0]['scope']}: {bad[0]['fault']}")
    condition = F.struct("fact", F.lit("eq").alias("op"), F.array("value").alias("values"))
    note = F.when(F.col("fact").isNull(), F.col("note")).otherwise(F.to_json(F.struct(F.coalesce("note", F.lit("")).alias("note"), condition.alias("condition"))))
    log = shaped(met.withColumns({"note": note, "at": F.coalesce("at", F.current_timestamp())}), "adjudications")
    last = met.groupBy(*KEY).agg(F.max(F.struct("at", "number", "verdict")).getField("verdict").alias("said"))
    after = rules.join(last, KEY, "left").withColumns({"status": F.coalesce("said", "status"), "reproposed_reason": F.when(F.col("said").isNull(), F.col("reproposed_reason"))})
    corpora = [r["corpus"] for r in last.select("corpus").distinct().collect()]
    after = written(after.select(rules.columns))
    changes = [("rules", c, after.where(F.col("corpus") == c), True) for c in corpora]
    store.commit(base, [*changes, ("adjudications", "", log, False)])


def record_everywhere(store: Store, id_: str, corpus: str, verdict: str, reviewer: str | None = None, note: str | None = None, calibrated: list[str] = ()) -> DataFrame:
    """One verdict at every scope of a corpus where the rule is proposed on evidence of its own; returns the others: scope, status, borrowed, holds, of."""
    rows = store.table("rules", part=corpus).where(F.col("id") == id_)
    if rows.isEmpty():
        raise ValueError(f"no rule {id_} in {corpus}")
    mine = F.coalesce((F.col("status") == "proposed") & (F.col("verdict") == "own"), F.lit(False))
    others = written(rows.where(~mine).select("scope", "status", (F.col("status") == "proposed").alias("borrowed"), "holds", "of"))
    nothing = F.lit(None).cast("string")
    record_verdicts(store, rows.where(mine).select(*KEY, F.lit(verdict).alias("verdict"), F.lit(note).cast("string").alias("note"), nothing.alias("fact"), nothing.alias("value"), F.lit(reviewer).cast("string").alias("reviewer"), F.current_timestamp().alias("at")), calibrated)
    return others


def history(store: Store, id_: str | None = None, scope: str | None = None, corpus: str | None = None) -> DataFrame:
    """All verdicts with note and condition apart: id, corpus, scope, at, verdict, note, condition, holds, of, reviewer.

    A note that isn't an object with a condition on a fact is free text, however it begins.
    """
    rows = store.table("adjudications")
    for column, value in (("id", id_), ("scope", scope), ("corpus", corpus)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.withColumn("said", F.when(F.col("note").startswith("{"), F.from_json("note", NOTE, {"mode": "PERMISSIVE"})))
    parsed = F.col("said.condition.fact").isNotNull()
    note = F.when(parsed, F.nullif(F.col("said.note"), F.lit(""))).otherwise(F.col("note"))
    return rows.select(*KEY, "at", "verdict", note.alias("note"), F.when(parsed, F.col("said.condition")).alias("condition"), "holds", "of", "reviewer")


def requested(store: Store, corpus: str) -> DataFrame:
    """What people asked to be mined under a condition, for plans.mine.mine: pattern, subject, guards, slot, conditions, parent_id."""
    asked = history(store, corpus=corpus).where("verdict = 'narrowed' and condition is not null").select(*KEY, "condition")
    rules = store.table("rules", part=corpus).where("status = 'narrowed'")
    return rules.join(asked, KEY).select("pattern", "subject", "guards", "slot", F.array("condition").alias("conditions"), F.col("id").alias("parent_id")).distinct()
