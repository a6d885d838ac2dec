"""Push events: admission, coalescing to the latest of each repository, statistics.

The batch forms serve streams too, inside foreachBatch.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodegraf.schema import PUSH_EVENT

DEFAULT_BRANCHES = ("main", "master")
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 30.0


def _glob(pattern: str) -> str:
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern) + "$"


def admission(rules: list[tuple[str, list[str]]]) -> Column:
    """Whether (repo, branch) is allowed: the last rule whose pattern matches decides, a leading ! denies, no match denies.

    Rules without branches stand for the default ones.
    """
    verdict = F.lit(False)
    for pattern, branches in rules:  # a later rule wraps the earlier ones
        deny, glob = pattern.startswith("!"), _glob(pattern.lstrip("!"))
        verdict = F.when(F.rlike("repo", F.lit(glob)), F.lit(False) if deny else F.col("branch").isin(*(branches or DEFAULT_BRANCHES))).otherwise(verdict)
    return verdict


def admitted(events: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    return events.where(admission(rules))


def latest(events: DataFrame) -> DataFrame:
    """repo, payload, seq, n: the newest payload of each repository. A map-side combined aggregate, whatever one repository sends."""
    return events.groupBy("repo").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"), F.count("*").alias("n"))


def parsed(lines: DataFrame) -> DataFrame:
    """repo, branch, commit, clone_url of push events in the column `value`; deletions, tags and broken lines drop."""
    e = F.from_json("value", PUSH_EVENT)
    rows = lines.select(e.alias("e"), *[c for c in lines.columns if c != "value"])
    ok = F.startswith("e.ref", F.lit("refs/heads/")) & ~F.coalesce("e.deleted", F.lit(False)) & F.col("e.repository.full_name").isNotNull()
    return rows.where(ok).select(F.col("e.repository.full_name").alias("repo"), F.substring("e.ref", 12, 1 << 20).alias("branch"), F.col("e.after").alias("commit"), F.col("e.repository.clone_url").alias("clone_url"), *[c for c in rows.columns if c != "e"])


def namespace_of(repo: Column) -> Column:
    """The name without its owner, slashes as dashes."""
    return F.regexp_replace(F.regexp_replace(repo, "^[^/]*/", ""), "/", "-")


def signed(body: bytes, secret: bytes, header: str) -> bool:
    """Whether the header is the body's HMAC-SHA256."""
    return hmac.compare_digest(hmac.new(secret, body, hashlib.sha256).hexdigest(), header.removeprefix("sha256="))


class NotRetryable(Exception):
    """A failure that another attempt will not mend."""


def with_retries(work: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> bool:
    """Up to three attempts, waiting one second and twice as long each time, at most thirty."""
    wait = FIRST_WAIT
    for attempt in range(ATTEMPTS):
        try:
            work()
            return True
        except NotRetryable:
            return False
        except Exception:
            if attempt == ATTEMPTS - 1:
                return False
            sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)
    return False


def run_queue(stream: DataFrame, rules: list[tuple[str, list[str]]], handle: Callable[[str, str, str], None], checkpoint: str, most: int = 1000, **trigger):
    """Start a query that hands each batch's newest admitted event of a repository to `handle(repo, branch, clone_url)`.

    At most `most` repositories of a batch are taken; a batch's rows are the
    repositories, not the events, so the driver sees few of them.
    """

    def one(batch: DataFrame, _: int) -> None:
        e = admitted(parsed(batch), rules).withColumn("seq", F.struct("time", "commit")).withColumn("payload", F.struct("branch", "clone_url"))
        rows = latest(e).orderBy("seq").limit(most + 1).collect()
        if len(rows) > most:
            raise RuntimeError(f"more than {most} repositories wait")
        failed = [r.repo for r in rows if not with_retries(lambda r=r: handle(r.repo, r.payload.branch, r.payload.clone_url))]
        if failed:
            raise RuntimeError(f"failed: {failed}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def queue_stats(events: DataFrame) -> DataFrame:
    """repo, n_events, first and last time: for batches, or as a stream in update mode."""
    return events.groupBy("repo").agg(F.count("*").alias("n_events"), F.min("time").alias("oldest"), F.max("time").alias("newest"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "20 minutes") -> DataFrame:
    """Events by window and type, with a watermark for late ones. An addition: event-time windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
