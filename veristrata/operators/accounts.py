"""Accounts, sessions, quotas, requests and settings as set operations over their tables.

Statements that change one row become expressions over whole tables: what a table holds after
them, or which rows they would delete. Nothing here is collected; every group is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.text import masked
from veristrata.operators.ranking import top

#: Seconds that a session lasts.
SESSION_SECONDS = 7 * 86_400
UNLIMITED = -1


def admins_first(users: DataFrame) -> DataFrame:
    """Administrators, then the others, each by their number."""
    return users.orderBy(F.desc(F.col("role") == "admin"), "user_id")


def raised(total: Column, delta: Column) -> Column:
    """A quota with an addition; an unlimited one stays unlimited."""
    return F.when(total < 0, F.lit(UNLIMITED)).otherwise(total + delta)


def taken(total: Column, used: Column, asked: Column) -> Column:
    """How many of the takes asked for pass: each needs room below the total, all pass without a limit."""
    return F.when(total < 0, asked).otherwise(F.greatest(F.lit(0), F.least(asked, total - used)))


def refunded(used: Column, back: Column) -> Column:
    """What is used after refunds, never below nothing."""
    return F.greatest(F.lit(0), used - back)


def expiry(created: Column, seconds: int = SESSION_SECONDS) -> Column:
    return created + F.make_dt_interval(secs=F.lit(seconds))


def live(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def signed_in(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not ended, with their enabled user."""
    return live(sessions, now).join(users.where("enabled"), "user_id")


def to_purge(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(token, reason) of sessions to delete: those that have ended, and those of disabled users."""
    ended = F.when(F.col("expires_at") <= now, "expired").when(~F.col("enabled"), "disabled")
    return sessions.join(users.select("user_id", "enabled"), "user_id").select("token", ended.alias("reason")).where("reason is not null")


def one_pending(requests: DataFrame) -> DataFrame:
    """(request_id, effective_id): a request while one of its user is pending comes to the pending one."""
    first = requests.where("status = 'pending'").groupBy("user_id").agg(F.min_by("request_id", F.struct("created_at", "request_id")).alias("effective_id"))
    return requests.where("status = 'pending'").join(first, "user_id").select("request_id", "effective_id")


def newest_requests(requests: DataFrame, users: DataFrame, status: str | None, limit: int = 200) -> DataFrame:
    """The newest requests with the name of their user, where there is one."""
    own = requests if status is None else requests.where(F.col("status") == status)
    last = own.orderBy(F.desc("created_at"), F.desc("request_id")).limit(limit)
    return last.join(users.select("user_id", F.col("login").alias("user_name")), "user_id", "left")


def newest_of_user(requests: DataFrame, limit: int = 20) -> DataFrame:
    return top(requests, ["user_id"], [F.desc("created_at"), F.desc("request_id")], limit)


def current_settings(writes: DataFrame, known: list[str]) -> DataFrame:
    """(key, value) after writes(key, value, at, seq): the last write of each known key; an empty one deletes the key."""
    last = writes.where(F.col("key").isin(known)).groupBy("key").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))
    return last.where("trim(value) <> ''").select("key", F.trim("value").alias("value"))


def public_settings(settings: DataFrame, secret: list[str]) -> DataFrame:
    """Settings as they may be shown: secrets masked."""
    return settings.select("key", F.when(F.col("key").isin(secret), masked(F.col("value"))).otherwise(F.col("value")).alias("shown"))


def first_filled(*choices: Column) -> Column:
    """The first of several values that is not blank, else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices], F.lit(""))


def by_login(typed: DataFrame, users: DataFrame) -> DataFrame:
    """Typed logins with their enabled user; upper and lower case make no difference."""
    return typed.withColumn("_k", F.lower("typed")).join(users.where("enabled").withColumn("_k", F.lower("login")), "_k").drop("_k")


def kept_since(log: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days, from the midnight of the first one on."""
    return log.where(F.col(at) >= F.date_trunc("day", now - F.make_dt_interval(days=F.lit(days))))


def fresh(entries: DataFrame, at: str, ok: str, now: Column, ok_days: int, failed_days: int) -> DataFrame:
    """Cache entries that still hold: successes longer than failures."""
    days = F.when(F.col(ok), F.lit(ok_days)).otherwise(F.lit(failed_days))
    return entries.where(F.col(at) + F.make_dt_interval(days=days) > now)
