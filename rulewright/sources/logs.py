"""Logs of several shapes, as events: interaction, at, kind, type, slots, text, operator, team, agent (and hints)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_SLOTS = "cast(map() as map<string,string>)"
DIALOGUES = (
    "corpus string, interactions array<struct<id:string,operator:string,team:string,agent:string,startedAt:bigint,outcome:string,"
    "turns:array<struct<speaker:string,intent:string,button:string,slots:map<string,string>,text:string>>>>"
)
TRANSCRIPT = "session string, timestamp string, type string, tool string, command string, text string"
#: What separates the actions of one shell command; a pipe doesn't.
SHELL = r"\s*(?:&&|\|\||;|\n)\s*"


def sequenced(events: DataFrame, order: list[str]) -> DataFrame:
    """events with seq, from 0 in the order of the contact."""
    return events.withColumn("seq", (F.row_number().over(Window.partitionBy("interaction").orderBy(*order)) - 1).cast("int"))


def _turns(rows: DataFrame) -> DataFrame:
    speaker = F.col("turn.speaker")
    kind = F.when(speaker == "action", "action").when((speaker == "customer") & F.col("turn.intent").isNotNull(), "customer_intent").when(speaker == "customer", "customer_utterance").when(speaker == "agent", "agent_utterance").when(speaker == "system", "system").otherwise("unknown")
    name = F.regexp_replace(F.coalesce("turn.button", "turn.intent"), "[ -]+", "_")
    type_ = F.when(kind == "action", F.concat(F.lit("action:"), name)).when(kind == "customer_intent", F.concat(F.lit("intent:"), name)).otherwise(kind)
    return rows.withColumns({"kind": kind, "type": F.coalesce(type_, F.lit("unknown")), "slots": F.coalesce("turn.slots", F.expr(NO_SLOTS)), "text": F.col("turn.text")})


def dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, interactions) of JSON files {corpus, interactions: [{id, operator, team, agent, startedAt, outcome, turns}]}."""
    contact = spark.read.schema(DIALOGUES).option("multiLine", True).json(path).select(F.explode("interactions").alias("c"))
    rows = contact.select(F.col("c.id").alias("interaction"), "c.operator", "c.team", "c.agent", F.col("c.startedAt").alias("started"), F.posexplode("c.turns").alias("seq", "turn"))
    events = _turns(rows).withColumn("at", F.col("started") + F.col("seq")).drop("turn", "started")
    return events, contact.select(F.col("c.id").alias("interaction"), "c.operator", "c.team", "c.agent", "c.outcome", F.expr(NO_SLOTS).alias("facts"))


def conversations_with_buttons(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines {convo_id, scenario {flow, subflow}, delexed: [{speaker, text, button, slots}]}: the subflow is the first turn's intent."""
    schema = "convo_id string, scenario struct<flow:string,subflow:string>, delexed array<struct<speaker:string,text:string,button:string,slots:map<string,string>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("convo_id").alias("interaction"), F.col("scenario.flow").alias("operator"), F.col("scenario.subflow").alias("subflow"), F.posexplode("delexed").alias("seq", "t"))
    intent = F.when(F.col("seq") == 0, F.col("subflow"))
    turn = F.struct("t.speaker", intent.alias("intent"), "t.button", "t.slots", "t.text")
    nothing = F.lit(None).cast("string")
    return _turns(rows.withColumn("turn", turn)).withColumns({"at": F.col("seq").cast("long"), "team": nothing, "agent": nothing}).drop("turn", "t", "subflow")


def tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines {task_id, trial, messages: [{role, content, tool_calls: [{name, arguments}]}]}, one file or a folder.

    Contacts are named by their file too. A tool call is an action; a tool's message is a system event.
    """
    schema = "task_id string, trial string, messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:map<string,string>>>>>"
    rows = spark.read.schema(schema).json(path).select("*", F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("file"))
    rows = rows.select(F.concat_ws("/", "file", "task_id", "trial").alias("interaction"), F.col("file").alias("operator"), F.posexplode("messages").alias("place", "m"))
    rows = rows.select("*", F.posexplode_outer("m.tool_calls").alias("call", "t"))
    role = F.col("m.role")
    kind = F.when(F.col("t").isNotNull(), "action").when(role == "user", "customer_utterance").when(role == "assistant", "agent_utterance").when(role == "tool", "system").otherwise("unknown")
    nothing = F.lit(None).cast("string")
    events = rows.withColumns({"kind": kind, "type": F.when(kind == "action", F.concat(F.lit("action:"), "t.name")).otherwise(kind), "slots": F.coalesce("t.arguments", F.expr(NO_SLOTS)), "text": F.col("m.content"), "at": F.col("place").cast("long"), "team": nothing, "agent": nothing})
    return sequenced(events, ["place", "call"]).drop("place", "call", "m", "t")


def process_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of an XES file, a trace a contact; the resource of most of a trace's events is its agent."""
    attribute = "array<struct<_key:string,_value:string>>"
    inner = f"string:{attribute},date:{attribute}"
    rows = spark.read.format("xml").option("rowTag", "trace").schema(f"string {attribute}, event array<struct<{inner}>>").load(path)
    of = lambda attributes, key: F.element_at(F.transform(F.filter(attributes, lambda a: a["_key"] == key), lambda a: a["_value"]), 1)
    first = lambda attributes, key: F.when(F.exists(attributes, lambda a: a["_key"] == key), of(attributes, key))
    rows = rows.select(first(F.col("string"), "concept:name").alias("interaction"), F.posexplode("event").alias("seq", "e"))
    rows = rows.withColumns({"name": first(F.col("e.string"), "concept:name"), "resource": first(F.col("e.string"), "org:resource"), "life": first(F.col("e.string"), "lifecycle:transition"), "when": first(F.col("e.date"), "time:timestamp")})
    agent = rows.groupBy("interaction").agg(F.mode("resource", deterministic=True).alias("agent"))
    nothing = F.lit(None).cast("string")
    events = rows.withColumns({"kind": F.lit("action"), "type": F.concat(F.lit("action:"), F.regexp_replace(F.lower("name"), r"\W+", "_")), "slots": F.map_filter(F.create_map(F.lit("lifecycle"), "life"), lambda k, v: v.isNotNull()), "text": nothing, "at": F.unix_millis(F.to_timestamp("when")), "operator": F.lit("log"), "team": nothing})
    return events.join(agent, "interaction").drop("e", "name", "resource", "life", "when")


def shell_actions(command: Column) -> Column:
    """A command as its actions: heredoc bodies are left out, parts without a word too."""
    bare = F.regexp_replace(command, r"(?s)<<-?\s*['\"]?(\w+)['\"]?(.*?)\n\s*\1\b", "")
    parts = F.split(bare, SHELL)
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*(?:\w+=\S+\s+)*([\w./-]+)", 1)), lambda w: w != "")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines {session, timestamp, type, tool, command, text}; a shell call is one action for each of its commands."""
    rows = spark.read.schema(TRANSCRIPT).json(path).withColumn("file", F.col("_metadata.file_path"))
    shell = F.col("tool") == "shell"
    words = F.when(shell, shell_actions(F.col("command"))).when(F.col("tool").isNotNull(), F.array("tool")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("session", "timestamp", "type", "text", "tool", F.posexplode_outer(words).alias("part", "word"))
    kind = F.when(F.col("word").isNotNull(), "action").when(F.col("type") == "user", "customer_utterance").when(F.col("type") == "assistant", "agent_utterance").otherwise("system")
    nothing = F.lit(None).cast("string")
    events = rows.withColumns({"interaction": F.col("session"), "kind": kind, "type": F.when(kind == "action", F.concat(F.lit("action:"), F.lower("word"))).otherwise(kind), "slots": F.expr(NO_SLOTS), "at": F.unix_millis(F.to_timestamp("timestamp")), "operator": F.lit("sessions"), "team": nothing, "agent": nothing})
    return sequenced(events, ["at", "part"]).select("interaction", "seq", "at", "kind", "type", "slots", "text", "operator", "team", "agent")


def additive(kept: DataFrame, fresh: DataFrame, key: str, size: Column) -> DataFrame:
    """Both copies of a corpus as one: nothing is lost, and of two versions of a record the longer stays."""
    return kept.unionByName(fresh).withColumn("size_", size).groupBy(key).agg(F.max_by(F.struct(*kept.columns), "size_").alias("r")).select("r.*")


def pointed(source: DataFrame, pointer: str) -> Column:
    """What a pointer (/a/0/b, with ~1 for / and ~0 for ~) names in a JSON text column `json`."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in (x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]))
    return F.get_json_object("json", path)
