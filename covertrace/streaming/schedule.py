"""Scheduled fetching: a window per rule, rows in, the mark moved only after success."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.operators import intake
from covertrace.sources.services import CALL_LIMIT


@dataclass(frozen=True)
class Outcome:
    """What became of one rule."""

    rule_id: int
    start: datetime
    end: datetime
    rows: int = 0
    inserted: int = 0
    capped: bool = False
    error: str | None = None


def run(rules: DataFrame, now: datetime, fetch: Callable[[dict, datetime, datetime], DataFrame], accept: Callable[[int, DataFrame], int], dry_run: bool = False) -> tuple[list[Outcome], DataFrame]:
    """Fetch each rule's window and hand its rows to ``accept`` (which says how many were new).

    Windows overlap the last success by a day, as late rows are caught by their natural keys. A failure is
    recorded and moves nothing; a dry run moves nothing either. Gives the outcomes and the rules as they now are.
    """
    windows = {r["rule_id"]: (r["window_start"], r["window_end"]) for r in intake.fetch_windows(rules, F.lit(now)).collect()}
    outcomes = []
    for rule in rules.orderBy("rule_id").collect():
        start, end = windows[rule["rule_id"]]
        try:
            rows = fetch(rule.asDict(), start, end)
            n = rows.count()
            new = 0 if dry_run else accept(rule["rule_id"], rows)
        except Exception as e:  # one source's failure leaves the others alone
            outcomes.append(Outcome(rule["rule_id"], start, end, error=f"{type(e).__name__}: {e}"[:500]))
        else:
            outcomes.append(Outcome(rule["rule_id"], start, end, n, new, n >= CALL_LIMIT))
    if dry_run:
        return outcomes, rules
    done = [(o.rule_id, o.error) for o in outcomes]
    marks = rules.sparkSession.createDataFrame(done, "rule_id long, _error string")
    moved = rules.join(F.broadcast(marks), "rule_id", "left")  # a row for each rule that people set up
    return outcomes, moved.withColumns({
        "last_polled_at": F.when(F.col("_error").isNull(), F.lit(now)).otherwise(F.col("last_polled_at")), "last_error": F.col("_error"),
    }).drop("_error")


def campaigns_to_recluster(outcomes: list[Outcome], rules: DataFrame) -> DataFrame:
    """(campaign_id) of the rules that brought something new."""
    fresh = [o.rule_id for o in outcomes if o.inserted]
    return rules.where(F.col("rule_id").isin(fresh) if fresh else F.lit(False)).select("campaign_id").distinct()
