"""Weekly state of every entity: coverage, tri-state thresholds, and the lifecycle fold.

The fold over an entity's weeks is one higher-order ``aggregate`` on the JVM: weeks arrive sorted in an
array and the state holds the history and the emitted events. ``let`` names an intermediate value, so
that each step's expressions stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import let

# Thresholds a day and a week, and the streaks that move a state.
MAIN_DAILY, SCOUT_WEEKLY, BREAKOUT_WEEKLY = 5, 3, 10
CONFIRMING_WEEKS, INACTIVATING_WEEKS = 2, 2

EVENT = "struct<type:string,week:date,previous_status:string,next_status:string>"
HISTORY = "struct<week:date,n:bigint,max_daily:bigint,active_days:bigint,coverage:string,main:boolean,scout:boolean,breakout:boolean,status:string,breakout_status:string,qualified:int,below:int>"
STATE = (
    "struct<status:string,cooling_from:string,qualified:int,below:int,first_detected:date,changed_at:date,last_qualified:date,"
    f"fast_ever:boolean,breakout_status:string,breakout_week:date,last_fast:boolean,weeks:array<{HISTORY}>,events:array<{EVENT}>>"
)


def rules(main: int = MAIN_DAILY, scout: int = SCOUT_WEEKLY, breakout: int = BREAKOUT_WEEKLY) -> dict[str, int]:
    if not 1 <= scout <= breakout or main < 1:
        raise ValueError("thresholds must be positive, and breakout at least scout")
    return {"main": main, "scout": scout, "breakout": breakout}


def membership(observed: Column, threshold: int, complete: Column) -> Column:
    """True if reached; false only if nothing can be missing; else unknown."""
    return F.when(observed >= threshold, True).when(complete, False)


def check_windows(days: DataFrame) -> DataFrame:
    """Rows (input, date) that don't follow their input's day before, or begin no later than an earlier input ends: must be empty."""
    order = Window.partitionBy("input").orderBy("date")
    inside = days.withColumn("before", F.lag("date").over(order)).filter(F.datediff("date", "before") != 1).select("input", "date")
    ends = days.groupBy("input").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("input"))).filter(F.datediff("first", "before") != 1)  # one row an input
    return inside.unionByName(between.select("input", F.col("first").alias("date")))


def week_coverage(days: DataFrame) -> DataFrame:
    """From date, hours_collected, records_complete (one row a day): coverage of every Monday week."""
    week = F.to_date(F.date_trunc("week", "date"))
    calendar, hours, records = F.count(F.lit(1)) == 7, F.bool_and(F.col("hours_collected") == 24), F.bool_and("records_complete")
    found = days.groupBy(week.alias("week")).agg(calendar.alias("calendar_complete"), (calendar & hours).alias("hours_complete"), (calendar & hours & records).alias("records_complete"))
    coverage = F.when(F.col("records_complete"), "complete").when(F.col("hours_complete"), "record-warning").otherwise("temporal-incomplete")
    return found.withColumn("coverage", coverage)


def integrity_state(verified: Column) -> Column:
    """Aggregate of a tri-state column: verified, unavailable (also over no rows) or partial."""
    return F.when(F.count(verified) == 0, "unavailable").when(F.count_if(verified) == F.count(F.lit(1)), "verified").otherwise("partial")


def weekly_metrics(daily: DataFrame) -> DataFrame:
    """key, week, n, max_daily, active_days."""
    return daily.groupBy("key", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        F.sum("n").alias("n"), F.max("n").alias("max_daily"), F.count_if(F.col("n") > 0).alias("active_days")
    )


def tracked_weeks(daily: DataFrame, coverage: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Every key in every week from that of its first event on, with tri-state flags.

    The weeks are one small row (an array in each key's row), so no cross join is planned.
    """
    limits = limits or rules()
    weekly = weekly_metrics(daily)
    grid = F.broadcast(coverage.agg(F.sort_array(F.collect_list(F.struct("week", "coverage", "records_complete"))).alias("grid")))  # one row
    found = weekly.groupBy("key").agg(
        F.min(F.when(F.col("n") > 0, F.col("week"))).alias("first"), F.map_from_entries(F.collect_list(F.struct("week", F.struct("n", "max_daily", "active_days")))).alias("counts")
    )
    each = found.join(grid).select("key", "first", "counts", F.explode("grid").alias("w")).filter(F.col("w.week") >= F.col("first"))
    count = lambda name: F.coalesce(F.try_element_at("counts", F.col("w.week"))[name], F.lit(0).cast("long"))
    rows = each.select("key", "w.week", "w.coverage", "w.records_complete", count("n").alias("n"), count("max_daily").alias("max_daily"), count("active_days").alias("active_days"))
    return rows.withColumns(
        {
            "main": membership(F.col("max_daily"), limits["main"], F.col("records_complete")),
            "scout": membership(F.col("n"), limits["scout"], F.col("records_complete")),
            "breakout": membership(F.col("n"), limits["breakout"], F.col("records_complete")),
        }
    )


def with_growth(tracked: DataFrame) -> DataFrame:
    """``grows``: strictly more than the tracked week before, which had more than the one before it, both completely covered."""
    order = Window.partitionBy("key").orderBy("week")
    one, two = (lambda c: F.lag(c, 1).over(order)), (lambda c: F.lag(c, 2).over(order))
    grows = (two("coverage") == "complete") & (one("coverage") == "complete") & (two("n") < one("n")) & (one("n") < F.col("n"))
    return tracked.withColumn("grows", F.coalesce(grows, F.lit(False)))


def _event(kind: str, week: Column, before: Column, after: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), week.alias("week"), before.alias("previous_status"), after.alias("next_status")).cast(EVENT)


def _some(*pairs: tuple[Column, Column]) -> Column:
    """The events whose condition holds, in order."""
    return F.concat(*(F.when(F.coalesce(c, F.lit(False)), F.array(e)).otherwise(F.array().cast(f"array<{EVENT}>")) for c, e in pairs))


def _step(s: Column, w: Column) -> Column:
    """The state after one more week."""
    qualifies, below = F.coalesce(w["scout"], F.lit(False)), F.coalesce(~w["scout"], F.lit(False))
    fast = F.coalesce(w["breakout"], F.lit(False))
    lost = w["coverage"] == "temporal-incomplete"
    matters = (lost | ((w["coverage"] == "record-warning") & ~qualifies)) & (s["status"].isNotNull() | F.coalesce(s["breakout_status"] == "pending", F.lit(False)))
    waiting = F.coalesce((s["breakout_status"] == "pending") & (s["breakout_week"] != w["week"]), F.lit(False))

    def settled(b: Column) -> Column:
        """b: confirmed, unconfirmed, new breakout, and whether that needs confirming."""
        new_status = (
            F.when(qualifies & s["status"].isNull(), F.when(~b["pends"] & w["grows"], "active").otherwise("candidate"))
            .when(qualifies & (s["status"] == "inactive"), "candidate")
            .when(qualifies & (s["status"] == "cooling"), F.coalesce(s["cooling_from"], F.lit("candidate")))
            .when(qualifies & (s["status"] == "candidate") & (b["confirmed"] | (s["qualified"] + 1 >= CONFIRMING_WEEKS)), "active")
            .when(below & s["status"].isin("candidate", "active"), "cooling")
            .when(below & (s["status"] == "cooling") & (s["below"] + 1 >= INACTIVATING_WEEKS), "inactive")
            .otherwise(s["status"])
        )
        breakout = (
            F.when(b["fresh"], F.when(b["pends"], "pending").otherwise("confirmed"))
            .when(b["confirmed"], "confirmed")
            .when(b["failed"], "unconfirmed")
            .otherwise(s["breakout_status"])
        )

        def moved(c: Column) -> Column:
            changed = ~c["status"].eqNullSafe(s["status"])
            kind = (
                F.when(c["status"] == "active", "activated")
                .when((c["status"] == "candidate") & F.coalesce(s["status"] == "inactive", F.lit(False)), "revived")
                .when(c["status"] == "candidate", "candidate_detected")
                .when(c["status"] == "cooling", "cooling_started")
                .otherwise("inactivated")
            )
            events = F.concat(
                _some(
                    (matters, _event("data_incomplete", w["week"], s["status"], s["status"])),
                    (b["confirmed"], _event("breakout_confirmed", w["week"], s["status"], s["status"])),
                    (b["failed"], _event("breakout_unconfirmed", w["week"], s["status"], s["status"])),
                    (b["fresh"], _event("breakout_detected", w["week"], s["status"], s["status"])),
                ),
                _some((changed, F.struct(kind.alias("type"), w["week"].alias("week"), s["status"].alias("previous_status"), c["status"].alias("next_status")).cast(EVENT))),
            )
            streak = F.when(qualifies, F.when(s["status"].isin("candidate", "active"), s["qualified"] + 1).otherwise(1)).otherwise(0)
            under = (
                F.when(qualifies, 0)
                .when(below & s["status"].isin("candidate", "active"), 1)
                .when(below & s["status"].isin("cooling", "inactive"), s["below"] + 1)
                .otherwise(s["below"])
            )
            cooling = (
                F.when(below & s["status"].isin("candidate", "active"), s["status"])
                .when((qualifies & (s["status"] == "cooling")) | (c["status"] == "inactive"), None)
                .otherwise(s["cooling_from"])
            )
            return F.struct(
                c["status"].alias("status"),
                cooling.alias("cooling_from"),
                streak.alias("qualified"),
                under.alias("below"),
                F.coalesce(s["first_detected"], F.when(changed, w["week"])).alias("first_detected"),
                F.when(changed, w["week"]).otherwise(s["changed_at"]).alias("changed_at"),
                F.when(qualifies, w["week"]).otherwise(s["last_qualified"]).alias("last_qualified"),
                (s["fast_ever"] | b["fresh"]).alias("fast_ever"),
                c["breakout"].alias("breakout_status"),
                F.when(b["fresh"], w["week"]).otherwise(s["breakout_week"]).alias("breakout_week"),
                F.when(qualifies, fast).when(below, False).otherwise(s["last_fast"]).alias("last_fast"),
                s["weeks"].alias("weeks"),
                F.concat(s["events"], events).alias("events"),
            ).cast(STATE)

        return let(F.struct(new_status.alias("status"), breakout.alias("breakout")), moved)

    fresh = fast & ~s["last_fast"]
    decided = let(
        F.struct(
            (waiting & qualifies).alias("confirmed"),
            (waiting & below).alias("failed"),
            fresh.alias("fresh"),
            (fresh & (s["status"].isNull() | (s["status"] == "inactive"))).alias("pends"),
        ),
        settled,
    )
    held = s.withField("qualified", F.lit(0)).withField("events", F.concat(s["events"], _some((matters, _event("data_incomplete", w["week"], s["status"], s["status"])))))
    after = F.when(lost, held.cast(STATE)).otherwise(decided)

    def recorded(t: Column) -> Column:
        row = F.struct(
            *(w[c].alias(c) for c in ("week", "n", "max_daily", "active_days", "coverage", "main", "scout", "breakout")),
            t["status"].alias("status"),
            t["breakout_status"].alias("breakout_status"),
            t["qualified"].alias("qualified"),
            t["below"].alias("below"),
        ).cast(HISTORY)
        return t.withField("weeks", F.concat(t["weeks"], F.array(row))).cast(STATE)

    return let(after, recorded)


def folded(tracked: DataFrame) -> DataFrame:
    """key and its final state, with the history of weeks and the emitted events."""
    columns = ("week", "n", "max_daily", "active_days", "coverage", "main", "scout", "breakout", "grows")
    series = with_growth(tracked).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("series"))
    none = F.lit(None)
    start = F.struct(none, none, F.lit(0), F.lit(0), none, none, none, F.lit(False), none, none, F.lit(False), F.array(), F.array()).cast(STATE)
    return series.select("key", F.aggregate("series", start, _step).alias("state"))


def lifecycle_weeks(states: DataFrame) -> DataFrame:
    """The weekly series: weeks with events, a status, or a breakout that waits."""
    rows = states.select("key", F.inline("state.weeks"))
    return rows.filter((F.col("n") > 0) | F.col("status").isNotNull() | F.coalesce(F.col("breakout_status") == "pending", F.lit(False)))


def lifecycle_events(states: DataFrame) -> DataFrame:
    """Emitted events with ``seq``, their order within the key. ``log_order`` is the order of the whole log."""
    return states.select("key", F.posexplode("state.events").alias("seq", "e")).select("key", "seq", "e.*")


def log_order(name: str = "key") -> list[Column]:
    """The order of the whole log: by week, then name as people sort it (case and accents set apart, punctuation before digits before letters), then as emitted."""
    return [F.col("week"), F.expr(f"collate({name}, 'UNICODE_CI_AI')"), F.col(name), F.col("seq")]


def final_states(states: DataFrame) -> DataFrame:
    fields = ("status", "cooling_from", "qualified", "below", "first_detected", "changed_at", "last_qualified", "fast_ever", "breakout_status")
    return states.select("key", *(F.col(f"state.{f}").alias(f) for f in fields))


def week_summary(daily: DataFrame, coverage: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """For each week: keys observed, and keys that are certain to reach each threshold."""
    limits = limits or rules()
    weekly = weekly_metrics(daily)
    return coverage.select("week", "coverage").join(weekly, "week", "left").groupBy("week", "coverage").agg(
        F.count_if(F.col("n") > 0).alias("observed"),
        F.count_if(F.col("max_daily") >= limits["main"]).alias("main"),
        F.count_if(F.col("n") >= limits["scout"]).alias("scout"),
        F.count_if(F.col("n") >= limits["breakout"]).alias("breakout"),
    )


def identified(observations: DataFrame) -> DataFrame:
    """``observations`` (input, name, id, current_name) with ``identity``: id:<n> if any input knows the name's id, else name:<name>.

    Metadata give an id to the name that was asked for and to the entity's current name; the latest input
    that knows an id for a name decides. A row's own id goes before those. Column ``current_name`` may be missing.
    """
    rows = observations if "current_name" in observations.columns else observations.withColumn("current_name", F.lit(None).cast("string"))
    names = rows.filter("id is not null").select("id", "input", F.explode(F.array_compact(F.array("name", "current_name"))).alias("n_"))
    known = names.groupBy(F.lower("n_").alias("key_")).agg(F.max_by("id", F.struct("input", "id")).alias("id_"))
    joined = rows.join(known, F.lower("name") == F.col("key_"), "left")
    own = F.coalesce("id", "id_")
    return joined.withColumn("identity", F.when(own.isNotNull(), F.concat(F.lit("id:"), own)).otherwise(F.concat(F.lit("name:"), F.lower("name")))).drop("key_", "id_")


def merged_identities(observations: DataFrame) -> DataFrame:
    """From observations, ``identified`` or not: identity, id, last name, aliases, availability, first and last time, total; renames and inputs merged.

    A current name goes before the observed one. ``availability`` follows from the last input that asked for
    metadata (column ``asked``, if there is one): available, unavailable, or unknown if none did.
    """
    named = observations if "identity" in observations.columns else identified(observations)
    name, asked = F.coalesce("current_name", "name"), F.col("asked") if "asked" in named.columns else F.lit(False)
    told = F.when(F.col("id").isNotNull(), "available").when(asked, "unavailable")
    return named.groupBy("identity").agg(
        F.max_by(name, F.struct("input", "name")).alias("full_name"),
        F.array_sort(F.array_union(F.collect_set("name"), F.collect_set("current_name"))).alias("aliases"),
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.struct("input", "name"))), F.lit("unknown")).alias("availability"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("n").alias("n"),
    ).withColumn("id", F.regexp_extract("identity", r"^id:(\d+)\z", 1).try_cast("long"))


def identity_days(daily: DataFrame, named: DataFrame) -> DataFrame:
    """key (the identity), date, n: the counts of each day of all an identity's names and inputs, from ``daily`` (input, key, date, n)."""
    of = named.select("input", F.lower("name").alias("key"), "identity").distinct()
    return daily.join(of, ["input", "key"]).groupBy(F.col("identity").alias("key"), "date").agg(F.sum("n").alias("n"))
