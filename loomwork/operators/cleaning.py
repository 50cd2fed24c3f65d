"""An audited cleaning pipeline for trip exports.

Each row is tagged once with the first step that removes it; the audit is one aggregate over the tags, not a pass for each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parsing import squeezed, title_case

#: The export's date layouts in order of priority: fixed values.
LAYOUTS = ("y-M-d H:m:s", "M/d/y H:m", "d-MMM-y H:m")
MIN_MINUTES, MAX_MINUTES = 1.0, 24 * 60
DROPS = ("duplicate ride_id", "unparseable timestamps", "negative duration", "under a minute", "over 24 hours")


def station(c: Column, acronyms: tuple[str, ...] = ("MARTA",)) -> Column:
    """A station's name: single spaces, title case, abbreviations written out, acronyms restored; null is empty."""
    s = title_case(squeezed(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, r"\bSt\.(?=\s|$)", "Street")
    s = F.regexp_replace(s, r"\bPk\b", "Park")
    for a in acronyms:
        s = F.regexp_replace(s, rf"\b{a.title()}\b", a)
    return s


def parsed(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in LAYOUTS])


def tagged(trips: DataFrame, row_id: str = "row_id") -> DataFrame:
    """trips(row_id, ride_id, started_at, ended_at, start_station, end_station, user_type), all text, with typed columns and `dropped_by`, null for rows that stay."""
    again = F.row_number().over(Window.partitionBy("ride_id").orderBy(row_id)) > 1
    t = trips.withColumn("_again", again).withColumns({"started_at": parsed(F.col("started_at")), "ended_at": parsed(F.col("ended_at")), "start_station": station(F.col("start_station")), "end_station": station(F.col("end_station"))})
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000
    t = t.withColumn("duration_min", minutes)
    m = F.col("duration_min")
    why = F.when(F.col("_again"), DROPS[0]).when(m.isNull(), DROPS[1]).when(m < 0, DROPS[2]).when(m < MIN_MINUTES, DROPS[3]).when(m > MAX_MINUTES, DROPS[4])
    return t.withColumn("dropped_by", why).drop("_again")


def kept(tags: DataFrame) -> DataFrame:
    """The rows that stay, with missing stations and users labelled and hour and weekday (Monday 0) added."""
    t = tags.where("dropped_by is null").drop("dropped_by")
    t = t.withColumn("end_station", F.when(F.col("end_station") == "", "Unknown").otherwise(F.col("end_station")))
    t = t.withColumn("user_type", F.coalesce(F.nullif(F.col("user_type"), F.lit("")), F.lit("unknown")))
    return t.withColumns({"hour": F.hour("started_at"), "dow": F.weekday("started_at")})


def audit(tags: DataFrame) -> DataFrame:
    """(step, n): rows read, rows removed by each step, labels given, rows kept."""
    stay = F.col("dropped_by").isNull()
    aggs = [F.count(F.lit(1)).alias("rows read"), *[F.count_if(F.col("dropped_by") == d).alias(d) for d in DROPS]]
    aggs += [F.count_if(stay & (F.col("end_station") == "")).alias("end stations labelled"), F.count_if(stay & (F.coalesce("user_type", F.lit("")) == "")).alias("user types labelled"), F.count_if(stay).alias("rows kept")]
    one = tags.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("step"), F.col(f"`{c}`").alias("n")) for c in one.columns])))


def findings(trips: DataFrame) -> DataFrame:
    """One row: medians overall and by user type, mean, weekday and member shares, the two weekday peak hours, the busiest station."""
    d, member, casual = F.col("duration_min"), F.col("user_type") == "member", F.col("user_type") == "casual"
    one = trips.agg(F.count(F.lit(1)).alias("trips"), F.median(d).alias("m"), F.median(F.when(member, d)).alias("mm"), F.median(F.when(casual, d)).alias("mc"), F.avg(d).alias("mean"), F.avg((F.col("dow") < 5).cast("int")).alias("wd"), F.avg(member.cast("int")).alias("ms"))
    peaks = trips.where("dow < 5").groupBy("hour").count().orderBy(F.desc("count"), "hour").limit(2).agg(F.sort_array(F.collect_list(F.struct(-F.col("count"), "hour"))).alias("p"))
    busiest = trips.groupBy("start_station").count().orderBy(F.desc("count"), "start_station").limit(1).select(F.col("start_station").alias("busiest_station"))
    t = one.join(peaks, how="left").join(busiest, how="left")
    r = lambda c, k=1: F.round(c, k)
    return t.select("trips", r(F.col("m")).alias("median_all"), r(F.col("mm")).alias("median_member"), r(F.col("mc")).alias("median_casual"), r(F.try_divide("mc", "mm"), 2).alias("casual_vs_member"), r(F.col("mean")).alias("mean_all"), r(100 * F.col("wd")).alias("weekday_share"), F.transform("p", lambda x: x["hour"]).alias("peak_hours"), r(100 * F.col("ms")).alias("member_share"), "busiest_station")
