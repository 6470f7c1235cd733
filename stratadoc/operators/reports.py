"""Time-windowed reports, briefings and lists."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadoc.functions import text as T

#: Days that are upcoming, or recently completed; rows of evidence a subject.
HORIZON, EVIDENCE = 7, 3
#: Days without a message that are a lapse.
LAPSE = 14
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def time_window(text: str, as_of: date) -> tuple[date, date]:
    """[start, end) of "last week", "this week", "last month", "June 2026", "2026-06", "last 30 days", "today" or "yesterday".

    Weeks start on Monday; "last n days" end with ``as_of``. The literals go
    into filters, so they reach the scan. Anything else raises ValueError.
    """
    t = " ".join(text.lower().split())
    monday, first = as_of - timedelta(days=as_of.weekday()), as_of.replace(day=1)
    after = lambda d: (d.replace(day=28) + timedelta(days=4)).replace(day=1)
    fixed = {
        "today": (as_of, as_of + timedelta(days=1)),
        "yesterday": (as_of - timedelta(days=1), as_of),
        "this week": (monday, monday + timedelta(days=7)),
        "last week": (monday - timedelta(days=7), monday),
        "this month": (first, after(first)),
        "last month": ((first - timedelta(days=1)).replace(day=1), first),
    }
    if t in fixed:
        return fixed[t]
    if m := re.fullmatch(r"(?:last|past) (\d+) (day|week)s?", t):
        n = int(m[1]) * (7 if m[2] == "week" else 1)
        return as_of - timedelta(days=n - 1), as_of + timedelta(days=1)
    if (m := re.fullmatch(r"([a-z]+) (\d{4})", t)) and m[1] in MONTHS:
        start = date(int(m[2]), MONTHS.index(m[1]) + 1, 1)
        return start, after(start)
    if m := re.fullmatch(r"(\d{4})-(\d{2})", t):
        start = date(int(m[1]), int(m[2]), 1)
        return start, after(start)
    raise ValueError(f"no time window: {text!r}")


def within(rows: DataFrame, column: str, window: tuple[date, date]) -> DataFrame:
    """A range on the bare column, so that it is pushed to the scan."""
    start, end = (F.lit(d.isoformat()).cast(rows.schema[column].dataType) for d in window)
    return rows.filter((F.col(column) >= start) & (F.col(column) < end))


def briefing(tasks: DataFrame, as_of: date, horizon: int = HORIZON) -> DataFrame:
    """Tasks (task_id, due, done, priority) with their bucket; others are left out. Tasks without a due date are never overdue."""
    d = F.to_date("due")
    at = F.lit(as_of)
    bucket = (
        F.when(F.col("done") & (d < at) & (d >= F.date_sub(at, horizon)), "recently_completed")
        .when(~F.col("done") & (d < at), "overdue").when(~F.col("done") & (d == at), "due_today")
        .when(~F.col("done") & (d > at) & (d <= F.date_add(at, horizon)), "upcoming")
    )
    return tasks.withColumn("bucket", bucket).filter("bucket is not null").select("task_id", d.alias("due"), "priority", "bucket")


def normalised(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def unchecked(text: Column) -> Column:
    """Titles of the items of a list that are not ticked off."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*] \[ \] ([^\n]+)$"), F.lit(1))


def carried_over(previous: DataFrame, completed: DataFrame) -> DataFrame:
    """Items (title) of the list before that are neither ticked nor completed since."""
    items = previous.select(F.explode(unchecked(F.col("text"))).alias("title"))
    return items.withColumn("norm", normalised(F.col("title"))).join(completed.select(normalised(F.col("title")).alias("norm")).distinct(), "norm", "left_anti").select("title")


def todo(parts: list[DataFrame], start: date, end: date) -> DataFrame:
    """(norm, title, due, priority, n_origins): items due before ``end`` or without a due date, merged by normalised title.

    Each part has title, due, priority, origin. The earliest due date and the
    highest priority of an item's mentions count.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    d = F.to_date("due")
    label = F.when(d < F.lit(start), "1-overdue").when(F.col("priority").startswith("1") | F.col("priority").startswith("2"), "2-high").when(d.isNull(), "4-carried").otherwise("3-normal")
    listed = out.filter(d.isNull() | (d < F.lit(end))).withColumn("norm", normalised(F.col("title"))).withColumn("label", label)
    return listed.groupBy("norm").agg(F.min("title").alias("title"), F.min(d).alias("due"), F.min("label").alias("label"), F.countDistinct("origin").alias("n_origins"))


def activity(events: DataFrame, day: Column, kind: str, user: str) -> DataFrame:
    return events.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(user).alias("n_users"))


def chat_activity(sent: DataFrame, mentions: DataFrame, pings: DataFrame, on: date) -> DataFrame:
    """One day's messages of three kinds (ts, user, channel, text), to be appended to the month's file."""
    kinds = [d.select("ts", "user", F.lit(k).alias("kind"), "channel", "text") for k, d in (("sent", sent), ("mention", mentions), ("ping", pings))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).filter(F.to_date("ts") == F.lit(on))


def meetings_to_export(meetings: DataFrame, on: date) -> DataFrame:
    return meetings.filter((F.to_date("ended_at") == F.lit(on)) & F.col("has_summary"))


def cards(all_cards: DataFrame, ids: list[str] = (), keyword: str | None = None) -> DataFrame:
    """Cards (card_id, title) by id, or by a keyword, all of whose tokens the title has."""
    chosen = F.col("card_id").isin(*ids)
    if keyword:
        asked = T.tokens(F.lit(keyword))
        chosen = chosen | ((F.size(asked) > 0) & (F.size(F.array_except(asked, T.tokens(F.col("title")))) == 0))
    return all_cards.filter(chosen)


def transcripts(turns: DataFrame) -> DataFrame:
    """One row a conversation: its turns in order, and the whole text. A conversation is one row by definition."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    lines = F.transform(ordered, lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(lines, "\n").alias("transcript"))


def trends(events: DataFrame, period: Column, kind: str) -> DataFrame:
    """(period, kind, n, delta): counts by period, and the change from the one before."""
    counts = events.groupBy(period.alias("period"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("delta", F.col("n") - F.lag("n").over(W.partitionBy("kind").orderBy("period")))


def signals(events: DataFrame, day: Column, kind: str, trailing: int = 7, least: float = 1.5) -> DataFrame:
    """(day, kind, n, z): days whose count stands out from the trailing days before it."""
    counts = events.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    w = W.partitionBy("kind").orderBy("day").rowsBetween(-trailing, -1)
    scored = counts.withColumn("mean", F.avg("n").over(w)).withColumn("sd", F.stddev_pop("n").over(w)).withColumn("seen", F.count("*").over(w))
    z = F.round((F.col("n") - F.col("mean")) / F.col("sd"), 6)
    return scored.filter((F.col("seen") == trailing) & (F.col("sd") > 0)).select("day", "kind", "n", z.alias("z")).filter(F.abs("z") >= least)


def gaps(expected: DataFrame, observed: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n): combinations with fewer observations than ``least``, those without any included."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    return expected.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)


def opportunities(metrics: DataFrame, k: int = 3) -> DataFrame:
    """The k worst subjects of each metric (metric, subject, value; lower is worse), with what they lack to the metric's mean."""
    mean = metrics.groupBy("metric").agg(F.avg("value").alias("mean"))
    order = W.partitionBy("metric").orderBy("value", "subject")
    worst = metrics.filter("value is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return worst.join(mean, "metric").select("metric", "subject", "value", "rank", F.round(F.col("mean") - F.col("value"), 6).alias("lacks"))


def sentiment(rows: DataFrame) -> DataFrame:
    """(subject, n, mean, label, confidence, action) of (subject, value, age); values are from -1 to 1."""
    mean, sd = F.avg("value"), F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    out = rows.groupBy("subject").agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.count("*") / (F.count("*") + 10.0) * (1 - sd / 2), 6).alias("confidence"))
    label = F.when(F.col("mean") >= 0.7, "healthy").when(F.col("mean") >= 0.5, "watch").otherwise("at_risk")
    action = F.when(F.col("label") == "at_risk", "escalate").when(F.col("label") == "watch", "check in").otherwise("none")
    return out.withColumn("label", label).withColumn("action", action)


def evidence(rows: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """The k rows of each subject that speak loudest."""
    order = W.partitionBy("subject").orderBy(F.abs("value").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def direction(rows: DataFrame, recent: Column) -> DataFrame:
    """(subject, recent_mean, prior_mean, trend): the sign of the difference of two means."""
    out = rows.groupBy("subject").agg(F.round(F.avg(F.when(recent, F.col("value"))), 6).alias("recent_mean"), F.round(F.avg(F.when(~recent, F.col("value"))), 6).alias("prior_mean"))
    d = F.col("recent_mean") - F.col("prior_mean")
    return out.withColumn("trend", F.when(d > 0.01, "up").when(d < -0.01, "down").when(d.isNotNull(), "flat"))


def wins(rows: DataFrame, metric: str, key: str, k: int = 10) -> DataFrame:
    return rows.orderBy(F.col(metric).desc(), key).limit(k)


def critique(promised: DataFrame) -> DataFrame:
    """(subject, n, n_late, late_share, worst_delay) of (subject, delay): delays in days, late above 0."""
    late = F.count_if(F.col("delay") > 0)
    return promised.groupBy("subject").agg(F.count("*").alias("n"), late.alias("n_late"), F.round(late / F.count("*"), 6).alias("late_share"), F.max("delay").cast("long").alias("worst_delay")).filter("n_late > 0")


def findings(promises: DataFrame, messages: DataFrame, as_of: date, window: tuple[date, date] | None = None, lapse: int = LAPSE) -> DataFrame:
    """(run_date, finding, subject, n, worst): what fell short in a time window, by default the week that ends with ``as_of``.

    ``promises`` has subject, made, due and done (null: not yet), ``messages``
    subject and day. Missed: due in the window and not done by its end, worst in
    days overdue. Delayed: done in it after they were due. Overpromised: more
    made than done in it. Lapsed: messages in it that ended more than ``lapse``
    days without any.
    """
    start, end = (F.lit(d) for d in window or time_window("last 7 days", as_of))
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    one = lambda rows, name, n, worst: rows.groupBy("subject").agg(n.alias("n"), worst.cast("long").alias("worst")).withColumn("finding", F.lit(name))
    late = F.col("done").isNull() | (F.col("done") >= end)
    days = messages.select("subject", "day").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(W.partitionBy("subject").orderBy("day")))).filter(inside("day") & (F.col("gap") > lapse))
    made, kept = F.count_if(inside("made")), F.count_if(F.coalesce(inside("done"), F.lit(False)))
    out = [
        one(promises.filter(inside("due") & late), "missed", F.count("*"), F.max(F.datediff(end, "due"))),
        one(promises.filter(inside("done") & (F.col("done") > F.col("due"))), "delayed", F.count("*"), F.max(F.datediff("done", "due"))),
        one(promises, "overpromised", made - kept, F.lit(None)),
        one(gaps, "lapsed", F.count("*"), F.max("gap")),
    ]
    found = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).filter("n > 0")
    return found.select(F.lit(as_of).alias("run_date"), "finding", "subject", "n", "worst")
