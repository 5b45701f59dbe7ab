"""Late-delivery labels, their comparison, observability and label-mature folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.columns import c, day, days_between, n_if, ratio, rnd, wilson
from parcelscope.operators.gold import DELIVERED, PROMISED, is_delivered

LABELS = ["timestamp_strict", "calendar_day", "calendar_day_plus_1_grace"]
# fixed values: lateness buckets (upper bound in days, name), in report order
MARGIN_BUCKETS = [(-8, "<= -8 days"), (-2, "-7 to -2 days"), (-1, "-1 day"), (0, "0 days / same promised day"),
                  (1, "+1 day"), (3, "+2 to +3 days"), (7, "+4 to +7 days"), (14, "+8 to +14 days"), (None, ">= +15 days")]
DELAY_BANDS = [(-14, "<= -14"), (-7, "-13 to -7"), (-3, "-6 to -3"), (-1, "-2 to -1"), (0, "0"), (1, "1"), (3, "2 to 3"),
               (7, "4 to 7"), (14, "8 to 14"), (30, "15 to 30"), (None, "> 30")]


def with_labels(task: DataFrame) -> DataFrame:
    """The three label definitions as 0/1 columns."""
    return task.withColumns({
        "timestamp_strict": (F.col(DELIVERED) > F.col(PROMISED)).cast("int"),
        "calendar_day": (day(DELIVERED) > day(PROMISED)).cast("int"),
        "calendar_day_plus_1_grace": (day(DELIVERED) > F.date_add(day(PROMISED), 1)).cast("int"),
        "margin_hours": days_between(DELIVERED, PROMISED) * 24})


def label_comparison(labelled: DataFrame) -> DataFrame:
    """Late counts, rate, Wilson interval and majority accuracy per definition."""
    agg = labelled.agg(F.count(F.lit(1)).alias("orders"), *[F.sum(k).cast("long").alias(k) for k in LABELS])
    d = agg.unpivot(["orders"], LABELS, "label", "late_orders")
    lo, hi = wilson(F.col("late_orders").cast("double"), F.col("orders").cast("double"))
    on_time = F.col("orders") - F.col("late_orders")
    return d.select("label", "orders", "late_orders", rnd(100 * ratio("late_orders", "orders")).alias("late_rate_pct"),
                    rnd(100 * lo).alias("ci_low_pct"), rnd(100 * hi).alias("ci_high_pct"),
                    rnd(F.greatest("late_orders", on_time) / F.col("orders")).alias("majority_accuracy"))


def disagreement(labelled: DataFrame) -> DataFrame:
    """Strict against calendar: disagreements and how many fall on the promised day."""
    differ = F.col("timestamp_strict") != F.col("calendar_day")
    same = differ & (day(DELIVERED) == day(PROMISED))
    return labelled.agg(F.count(F.lit(1)).alias("orders"), n_if(differ).alias("disagreements"), n_if(same).alias("same_day"),
                        rnd(100 * ratio(n_if(same), n_if(differ))).alias("same_day_share_pct"),
                        n_if((F.col("calendar_day") == 1) & (F.col("timestamp_strict") == 0)).alias("calendar_late_strict_ontime"))


def time_of_day(df: DataFrame, columns: list[str]) -> DataFrame:
    """Midnight share and number of different clock times per timestamp."""
    long = df.unpivot([], [F.date_format(k, "HH:mm:ss").alias(k) for k in columns], "column_name", "clock").filter("clock is not null")
    g = long.groupBy("column_name", "clock").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("column_name").agg(
        F.sum("n").alias("rows_known"), F.count(F.lit(1)).alias("unique_times"),
        rnd(100 * F.sum(F.when(F.col("clock") == "00:00:00", F.col("n")).otherwise(0)) / F.sum("n")).alias("midnight_pct"))


def banded(value, bands) -> Column:
    """Right-closed bands in order; the last one is open."""
    out = F.when(c(value).isNull(), F.lit(None))
    for top, name in bands[:-1]:
        out = out.when(c(value) <= top, name)
    return out.otherwise(bands[-1][1])


def observation_class(orders: DataFrame) -> DataFrame:
    """Six observability classes; censoring is judged against the last delivery in the data."""
    end = orders.agg(F.max(DELIVERED)).scalar()
    actual, promised = F.col(DELIVERED), F.col(PROMISED)
    task = is_delivered() & F.col("order_purchase_timestamp").isNotNull() & actual.isNotNull() & promised.isNotNull()
    terminal = F.coalesce(F.col("order_status").isin("canceled", "unavailable"), F.lit(False)) & ~task
    cls = (F.when(actual.isNull() & (promised <= end) & ~terminal, "OUTCOME_UNOBSERVED_BY_DATASET_END")
           .when(actual.isNull() & (promised > end) & ~terminal, "RIGHT_CENSORING_CANDIDATE")
           .when(actual.isNotNull() & (F.coalesce(F.col("order_status"), F.lit("")) != "delivered"), "OUTCOME_PRESENT_STATUS_MISMATCH")
           .when(terminal, "NOT_APPLICABLE_TERMINAL_NON_DELIVERY").when(task, "OBSERVED_DELIVERED").otherwise("OTHER_REVIEW"))
    return orders.select("order_id", "order_purchase_timestamp", cls.alias("observation_class"))


def recommendation(disagree: DataFrame, promised_midnight: DataFrame, midnight_min: float = 99.0, same_day_min: float = 95.0) -> DataFrame:
    """Calendar label is recommended when the promise is a date and disagreements are same-day."""
    d = disagree.withColumn("midnight_pct", promised_midnight.select("midnight_pct").scalar())
    ok = (F.col("midnight_pct") >= midnight_min) & (F.col("disagreements") > 0) & (F.col("same_day_share_pct") >= same_day_min)
    return d.select("disagreements", "same_day_share_pct", "midnight_pct",
                    F.when(ok, "CALENDAR_DAY_RECOMMENDED_PENDING_BUSINESS_CONFIRMATION").otherwise("BUSINESS_RULE_REVIEW_REQUIRED").alias("recommendation"))


def maturity_folds(task: DataFrame) -> DataFrame:
    """Per test month: label-mature training rows (bought and delivered before the month) and immature ones.

    A cutoff is a month start, so counting by the month in which a row becomes usable and running a
    sum over the small monthly table replaces the month x row range join.
    """
    usable = F.date_format(F.greatest("order_purchase_timestamp", DELIVERED), "yyyy-MM")
    by_usable = task.groupBy(usable.alias("month")).agg(F.count(F.lit(1)).alias("t"), F.sum("late").alias("tp"))
    by_month = task.groupBy(F.col("purchase_month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("p"))
    m = by_month.join(by_usable, "month", "full").na.fill(0, ["n", "p", "t", "tp"])
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)

    def run(col):
        return F.coalesce(F.sum(col).over(w), F.lit(0))
    d = m.select("month", F.col("n").alias("test_rows"), F.col("p").alias("test_pos"), run("t").alias("train_rows"), run("tp").alias("train_pos"),
                 (run("n") - run("t")).alias("immature_rows")).filter("test_rows > 0")
    tn, sn = F.col("train_rows") - F.col("train_pos"), F.col("test_rows") - F.col("test_pos")
    status = (F.when(F.col("train_rows") == 0, "EMPTY").when((F.col("train_pos") == 0) | (tn == 0), "SINGLE_CLASS_TRAIN")
              .when((F.col("test_pos") == 0) | (sn == 0), "SINGLE_CLASS_TEST").otherwise("READY"))
    return d.withColumn("status", status)
