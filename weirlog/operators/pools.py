"""Pools by derivation: what others move between tables follows here from the log and the history of tags.

The first request of an address for an attack URI flags the address. That row has the reason attack_uri:X; rows of the
address that arrive later have ip_flag:attack_uri:X; earlier ones, and all rows of addresses flagged by behaviour, have
the address's reason. All of it follows from a summary by address whose figures can be merged: its first attack, its hits
and errors. So rows that arrive later only merge their addresses' figures; a row's pool follows from the row, the verdict on
its address, and the address's tags. The pool of a tagged address's row follows from the tag alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.functions import agents, labels, lists
from weirlog.operators.aggregates import error_reason


def label(events: DataFrame, rules: lists.AttackRules | None = None, bots: list[str] | None = None, geo: DataFrame | None = None, v6: bool = True, local: list[str] | None = None) -> DataFrame:
    """Normalised events with all labels of a row by itself; `attack` is the reason of its URI or null. Addresses that begin with a text of local are local besides."""
    agent = F.col("user_agent")
    out = events.withColumn("_agent", agents.parsed(agent)).withColumns({
        "status_class": labels.status_class(F.col("status")), **{c: F.col(f"_agent.{c}") for c in ("browser", "os", "device")},
        "is_bot": labels.is_bot(agent, bots).cast("int"), "is_local": labels.is_local(F.col("ip"), v6, local).cast("int"), "is_static": labels.is_static(F.col("uri")).cast("int"),
        "attack": labels.attack_reason(F.col("uri"), rules), "visitor_hash": labels.visitor_hash(F.col("ip"), agent, F.col("ts")),
    })
    out = out.withColumn("device", F.when((F.col("device") == "Other") & (F.col("is_bot") == 1), "Bot").otherwise(F.col("device"))).drop("_agent")
    for c in ("country", "city"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    if geo is not None:
        from weirlog.sources.geo import locate

        out = locate(out.drop("country", "city"), geo)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """(ip, first, hits, errors, n) of labelled rows by address: first attack (seq, attack), hits and client errors of what is neither local nor a bot, and all rows."""
    public = F.col("is_local") == 0
    person = public & (F.col("is_bot") == 0)
    return rows.groupBy("ip").agg(
        F.min(F.when(public & F.col("attack").isNotNull(), F.struct("seq", "attack"))).alias("first"),
        F.count_if(person).alias("hits"), F.count_if(person & F.col("status").between(400, 499)).alias("errors"), F.count("*").alias("n"),
    )


def merged(summaries: DataFrame) -> DataFrame:
    """The summary of all rows of which parts have been summarised."""
    return summaries.groupBy("ip").agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("hits", "errors", "n")])


def verdicts(addresses: DataFrame, least: int = 15, rate: float = 0.70) -> DataFrame:
    """(ip, first_seq, uri_reason, reason) of the addresses of a summary that are flagged."""
    behaviour = F.when((F.col("hits") >= least) & (F.col("errors") / F.col("hits") >= rate), error_reason(F.col("hits"), F.col("errors")))
    return addresses.select("ip", F.col("first.seq").alias("first_seq"), F.col("first.attack").alias("uri_reason"), F.coalesce("first.attack", behaviour).alias("reason")).where("reason is not null")


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Labelled rows with pool and malicious_reason by verdicts on their addresses."""
    rows = rows.join(found.withColumnRenamed("ip", "_ip"), F.col("ip") == F.col("_ip"), "left")
    at_first, later = F.col("seq") == F.col("first_seq"), F.col("seq") > F.col("first_seq")
    # Local rows of a flagged address stay local on arrival, but promotion moves all rows of the address.
    reason = F.when(later & (F.col("is_local") == 0), F.concat(F.lit("ip_flag:"), F.col("uri_reason"))).when(at_first, F.col("uri_reason")).otherwise(F.col("reason"))
    pool = F.when(F.col("malicious_reason") != "", "malicious").when(F.col("is_static") == 1, "static").otherwise("dynamic")
    return rows.withColumn("malicious_reason", F.coalesce(reason, F.lit(""))).withColumn("pool", pool).drop("_ip", "first_seq", "uri_reason", "reason")


def assign(rows: DataFrame, history: DataFrame | None = None, **thresholds) -> DataFrame:
    """Labelled rows with pool and malicious_reason, and the flags that tags override; see override()."""
    return override(judged(rows, verdicts(summary(rows), **thresholds)), history)


def override(stored: DataFrame, history: DataFrame | None, listed: list[str] | None = None) -> DataFrame:
    """Rows with their pools, as they are with a history(ip, tag, n) of tags in the order n.

    The last tag of an address decides the pool of its rows, the last one that isn't malicious their flags. Nothing else is
    looked at: rows of other addresses are read as they are stored, with filters on pool and day, and those of tagged ones
    with filters on day and, for each kind of tag, on what makes up the pool then; a filter on a pool that a kind of tag
    rules out leaves that part out altogether. A short list of the tagged addresses goes into the scan's filter.
    """
    if history is None:
        return stored
    other = F.col("tag") != "malicious"
    last = history.groupBy(F.col("ip").alias("_ip")).agg(F.max_by("tag", "n").alias("tag"), F.max_by(F.when(other, F.col("tag")), F.when(other, F.col("n"))).alias("flag_tag"))
    columns = stored.columns
    flag = lambda name, tag: F.when(F.col("flag_tag") == tag, 1).when(F.col("flag_tag").isNotNull(), 0).otherwise(F.col(name)).alias(name)
    made = {"is_bot": flag("is_bot", "bot"), "is_local": flag("is_local", "local")}

    def tagged(test: Column, reason: str, pool: Column) -> DataFrame:
        rows = (stored if listed is None else stored.where(F.col("ip").isin(listed))).join(last.where(test), F.col("ip") == F.col("_ip"))
        return rows.select(*[(made | {"malicious_reason": F.lit(reason).alias("malicious_reason"), "pool": pool.alias("pool")}).get(c, F.col(c)) for c in columns])

    rest = stored.join(last.select("_ip"), F.col("ip") == F.col("_ip"), "left_anti")
    bad = tagged(F.col("tag") == "malicious", "manual:tagged", F.lit("malicious"))
    return rest.unionByName(bad).unionByName(tagged(other, "", F.when(F.col("is_static") == 1, "static").otherwise("dynamic")))
