"""Advice on a stream of requests with text: predicates are asked about each different text once, then the rules.

The texts that are known, with their answers, and the calls that were made are state, in shards by the text's hash. An entry is
dropped when the watermark is `forget` past its last use, so that state is bounded by the texts of that span of time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.identity import short_hash
from ..functions.text import redact_text
from ..operators.advise import advise
from ..operators.facts import overlaid
from ..operators.observe import band

#: A request of operators.advise, with at and the episode's events in order.
EVENTS = "array<struct<type:string,text:string,slots:map<string,string>>>"
ASKED = "request string, body string, at timestamp, place int, preds array<string>, sha string, text string"
ANSWERED = "request string, body string, at timestamp, place int, preds array<string>, p array<double>, problem string"

#: (text, patterns) -> a probability for each; may raise.
Observer = Callable[[str, list[str]], list[float]]


def pattern_observer(text: str, patterns: list[str]) -> list[float]:
    return [0.97 if re.search(p, text) else 0.05 for p in patterns]


def asked_texts(requests: DataFrame, predicates: DataFrame) -> DataFrame:
    """ASKED: a row for each different redacted text of a request, with the predicates that read it and the place of the last event that has it; one without text for a request that has none.

    predicates (pred, fact, window, pattern, assert_at, refute_at) are as few as people wrote, and broadcast. A request is carried along as JSON.
    """
    rules = predicates.agg(F.collect_list(F.struct("pred", "window")).alias("all"))
    rows = requests.select("request", F.to_json(F.struct(*(c for c in requests.columns if c != "events"))).alias("body"), "at", "events").crossJoin(F.broadcast(rules))
    said = F.transform("events", lambda e: F.when(F.length(F.trim(e["text"])) > 0, e["text"]))

    def text_of(rule: Column, event: Column, place: Column) -> Column:
        so_far = F.array_join(F.slice(said, F.lit(1), place + 1), "\n")
        slot = event["slots"][F.regexp_replace(rule["window"], "^slot[.]", "")]
        return F.when(rule["window"] == "event.text", said[place]).when(rule["window"] == "episode.text", F.nullif(so_far, F.lit(""))).otherwise(slot)

    reads = F.flatten(F.transform("events", lambda e, i: F.transform("all", lambda r: F.struct(i.alias("place"), r["pred"].alias("pred"), redact_text(text_of(r, e, i)).alias("text")))))
    some = F.filter(reads, lambda x: x["text"].isNotNull())
    texts = F.array_distinct(F.transform(some, lambda x: x["text"]))
    grouped = F.transform(
        texts,
        lambda t: F.struct(
            F.array_max(F.transform(F.filter(some, lambda x: x["text"] == t), lambda x: x["place"])).alias("place"),
            F.array_sort(F.array_distinct(F.transform(F.filter(some, lambda x: x["text"] == t), lambda x: x["pred"]))).alias("preds"),
            t.alias("text"),
        ),
    )
    each = rows.select("request", "body", "at", F.explode_outer(F.when(F.size("events") > 0, grouped)).alias("g"))
    return each.select("request", "body", "at", F.col("g.place").cast("int").alias("place"), F.col("g.preds").alias("preds"), short_hash(F.col("g.text")).alias("sha"), F.col("g.text").alias("text"))


def answers(asked: DataFrame, patterns: dict[str, str], observer: Observer = pattern_observer, late: str = "10 minutes", forget: str = "1 day", budget: int | None = None, shards: int = 16) -> DataFrame:
    """ANSWERED: each text with its probabilities, from state where it was asked before; problem: why it wasn't answered.

    budget: calls in all, dealt to the shards by number, so that shards first are those with one more. A text that the observer fails
    on costs a call and is asked again. A known text costs none. Requests that come after the watermark are dropped.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        known, used = json.loads(state.get[0]) if state.exists else {}, state.get[1] if state.exists else 0
        mark = state.getCurrentWatermarkMs()
        most = None if budget is None else budget // shards + (shard < budget % shards)
        if state.hasTimedOut:
            frames = iter(())
        out = []
        rows = pd.concat([pd.DataFrame(), *frames])
        for r in rows.sort_values(["at", "request", "place"]).itertuples() if len(rows) else ():
            p, problem = None, None
            if r.sha is not None:
                preds, now = list(r.preds), int(r.at.timestamp() * 1000)
                own, last = known.get(r.sha, ({}, 0))
                missing = [x for x in preds if x not in own]
                if missing and most is not None and used >= most:
                    problem = "budget spent"
                elif missing:
                    used += 1
                    try:
                        own = own | dict(zip(missing, observer(r.text, [patterns[x] for x in missing])))
                    except Exception as error:  # whatever an observer raises is told, and the request answered without it
                        problem = f"unreachable: {error}"
                if not problem:
                    known[r.sha] = (own, max(last, now))
                    p = [float(own[x]) for x in preds]
            out.append((r.request, r.body, r.at, r.place, r.preds, p, problem))
        known = {k: v for k, v in known.items() if v[1] + wait > mark}
        state.update((json.dumps(known), used))
        if known:
            state.setTimeoutTimestamp(max(mark + 1, min(v[1] for v in known.values()) + wait))
        if out:
            yield pd.DataFrame(out, columns=["request", "body", "at", "place", "preds", "p", "problem"])

    # requests without text have nothing to look up, and are dealt by themselves
    shard = F.pmod(F.xxhash64(F.coalesce("sha", "request")), F.lit(shards)).cast("int")
    rows = asked.withWatermark("at", late).withColumn("shard", shard)
    return rows.groupBy("shard").applyInPandasWithState(step, ANSWERED, "known string, used int", "append", GroupStateTimeout.EventTimeTimeout)


def observed_requests(answered: DataFrame, predicates: DataFrame, body: str) -> DataFrame:
    """Of a batch of answers, its requests (body: the schema they were carried in) with observer, observations (fact, p, value), and facts with what was observed under their own.

    Bands make a probability a value here, whatever an observer says. Of answers about one fact that of the later event wins, and one
    that is withheld only where there is no other. An unreachable observer takes all observations of the request with it; where the budget
    is spent, those that were answered stay.
    """
    keys = ["request", "body", "at"]
    pairs = answered.where("p is not null").select(*keys, "place", F.explode(F.arrays_zip("preds", "p")).alias("x")).select(*keys, "place", F.col("x.preds").alias("pred"), F.col("x.p").alias("p"))
    terms = F.broadcast(predicates.select("pred", "fact", "assert_at", "refute_at"))
    seen = pairs.join(terms, "pred").withColumn("value", band(F.col("p"), F.col("assert_at"), F.col("refute_at")))
    order = F.struct(F.col("value").isNotNull().alias("told"), F.when(F.col("value").isNull(), -F.col("place")).otherwise(F.col("place")).alias("place"), "pred")
    facts = seen.groupBy(*keys, "fact").agg(F.max_by(F.struct("p", "value"), order).alias("best"))
    facts = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fact", F.col("best.p").alias("p"), F.col("best.value").alias("value")))).alias("observed"))
    troubles = answered.groupBy(*keys).agg(F.min(F.when(F.col("problem").startswith("unreachable"), F.col("problem"))).alias("broken"), F.min("problem").alias("problem"), F.count("preds").alias("texts"))
    rows = troubles.join(facts, keys, "left")
    none = F.array().cast("array<struct<fact:string,p:double,value:string>>")
    kept = F.when(F.col("broken").isNotNull(), none).otherwise(F.coalesce("observed", none))
    why = F.coalesce("broken", F.when(F.size(kept) == 0, F.coalesce("problem", F.when(F.col("texts") == 0, F.lit("no text in the request")))))
    rows = rows.select("request", F.from_json("body", body).alias("r"), kept.alias("observations"), F.when(why.isNull(), F.lit("live")).otherwise(F.concat(F.lit("null ("), why, F.lit(")"))).alias("observer"))
    told = F.map_from_entries(F.transform(F.filter("observations", lambda o: o["value"].isNotNull()), lambda o: F.struct(o["fact"], o["value"])))
    own = F.coalesce("r.facts", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    return rows.select("r.*", "observer", "observations", overlaid(told, own).alias("known")).withColumn("facts", F.col("known")).drop("known")


def observed_advice(
    requests: DataFrame, predicates: DataFrame, obligations: DataFrame, recommendations: DataFrame, log: Callable[[DataFrame, int], None], observer: Observer = pattern_observer, version: int = 1, **bounds
) -> DataStreamWriter:
    """Answers a stream of requests (operators.advise.REQUESTS, at, events: EVENTS) and hands decision records to `log`, by batch number.

    A record: at, request, operator, considering, verdict, reason, missing, fired (rules that spoke), observer, and observations (fact, p, value, pv)
    without any text. predicates: those that may be asked, as operators.observe.active gives them. bounds: of answers().
    """
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema if f.name != "events")
    patterns = {r["pred"]: r["pattern"] for r in predicates.select("pred", "pattern").collect()}  # as few as people wrote
    found = answers(asked_texts(requests, predicates), patterns, observer, **bounds)

    def answer(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # each use would ask again; where a part is lost, its texts are
        asked = observed_requests(batch, predicates, body)
        said = advise(asked.drop("observer", "observations", "at"), obligations, recommendations)
        own = asked.select("request", "at", "observer", F.transform("observations", lambda o: F.named_struct(F.lit("fact"), o["fact"], F.lit("p"), o["p"], F.lit("value"), o["value"], F.lit("pv"), F.lit(version))).alias("observations"))
        fired = F.array_sort(F.array_union("warned", "cleared")).alias("fired")
        log(said.join(own, "request").select("at", "request", "operator", "considering", "verdict", F.col("why").alias("reason"), "missing", fired, "recommended", "observer", "observations"), number)
        batch.unpersist()

    return found.writeStream.foreachBatch(answer)
