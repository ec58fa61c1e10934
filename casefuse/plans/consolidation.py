"""From recorded calls to decided fields."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse.functions.rules import failure_cause
from casefuse.operators import ordered, replies, resolve, voting
from casefuse.sources.tables import bucketed, written


@dataclass
class Consolidation:
    """Results of `consolidate`, each computed when it is used."""

    parsed: DataFrame
    voted: DataFrame
    types: DataFrame
    issues: DataFrame
    candidates: DataFrame
    decisions: DataFrame
    values: DataFrame


def reported_types(parsed: DataFrame) -> DataFrame:
    """First document type the replies report for each document."""
    told = F.trim("reply.tipo_documento")
    return parsed.where(told != "").groupBy("case_id", "doc_id").agg(
        F.min_by(told, "seq").alias("doc_type"))


def counted_calls(calls: DataFrame, coverage=None, staged: bool = False, buckets: int = None,
                  values: bool = True) -> DataFrame:
    """Calls up to the ends of their cases, with their status line and digested reply.

    Parameters are those of `consolidate`. Without `values`, replies hold no more than the ends of
    cases, the status of calls and `identification` need, which is cheaper to make and to write.
    """
    if staged and not buckets:
        calls, buckets = ordered.together(calls, ["case_id"], F.col("seq"))
    parsed = replies.digest(replies.call_status(replies.parse_replies(calls)).drop("text"),
                            None if values else list(coverage or ()))
    if staged:
        parsed = bucketed(parsed, "parsed-replies", buckets, ["case_id", "part"])
    stops = voting.stops(parsed, coverage)
    return voting.before_stops(parsed, written(stops, "stops") if staged else stops)


def identification(parsed: DataFrame) -> DataFrame:
    """Identification type most replies of a case report."""
    return voting.majority_type(parsed.withColumn(
        "tipo_identificacion", F.col("reply.tipo_identificacion")))


def call_issues(parsed: DataFrame) -> DataFrame:
    """Last failure of each engine that failed in a case, and its cause."""
    return voting.last_status(parsed).withColumn("cause", failure_cause(F.col("status")))


def consolidate(calls: DataFrame, documents: DataFrame = None, protected: DataFrame = None,
                coverage=None, staged: bool = False, buckets: int = None) -> Consolidation:
    """Parse, cut, vote, trace, decide and fill many cases at once.

    `calls(case_id, doc_id, engine, seq, http_code, ok, error, text)`,
    `documents(case_id, doc_id, doc_type)` (by default the type the replies report first),
    `protected(case_id, field)`. With `coverage`, a case stops at the first call after which all
    those fields have a value. With `staged`, the digested replies are written once to the shared
    folder (at once, when this is called), in buckets of a case, and every branch reads them from
    there, the cuts included; without it each branch decodes again, which is cheaper on small input
    only. `buckets` says that `ordered.together` has dealt the calls into so many partitions, so that
    texts need not be shuffled.
    """
    parsed = counted_calls(calls, coverage, staged, buckets)
    votes = replies.votes(parsed)
    voted = voting.aggregate_votes(votes)
    types, issues = identification(parsed), call_issues(parsed)
    if documents is None:
        documents = reported_types(parsed)
    holders = resolve.document_holders(replies.packages(parsed))
    foreign = resolve.intruder_documents(holders, resolve.expected_holder(holders))
    merged = resolve.merge_candidates(resolve.reply_candidates(parsed))
    decisions = resolve.states(resolve.trace(
        resolve.first_candidates(merged, protected), documents, foreign))
    return Consolidation(parsed, voted, types, issues, resolve.trace(merged, documents, foreign), decisions,
                         resolve.autofill(decisions, protected))
