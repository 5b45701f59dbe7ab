"""Data-quality operators: every rule set is compiled to one aggregate per table, then to check rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import c, n_if, rnd

# fixed values: allowed domains
ALLOWED_STATUS = ["created", "approved", "invoiced", "processing", "shipped", "delivered", "unavailable", "canceled"]
ALLOWED_PAYMENT = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]
# fixed values: numeric rules (table, column) -> (min, min inclusive, max, max inclusive)
NUMERIC_RULES = {
    ("items", "price"): (0, True, None, True),
    ("items", "freight_value"): (0, True, None, True),
    ("payments", "payment_value"): (0, True, None, True),
    ("payments", "payment_installments"): (0, True, None, True),
    ("reviews", "review_score"): (1, True, 5, True),
    ("products", "product_weight_g"): (0, True, None, True),
    ("products", "product_length_cm"): (0, False, None, True),
    ("products", "product_height_cm"): (0, False, None, True),
    ("products", "product_width_cm"): (0, False, None, True),
    ("geolocation", "geolocation_lat"): (-90, True, 90, True),
    ("geolocation", "geolocation_lng"): (-180, True, 180, True),
}
TEMPORAL_RULES = [("purchase_before_approval", "order_purchase_timestamp", "order_approved_at"),
                  ("approval_before_carrier", "order_approved_at", "order_delivered_carrier_date"),
                  ("carrier_before_customer", "order_delivered_carrier_date", "order_delivered_customer_date"),
                  ("purchase_before_customer", "order_purchase_timestamp", "order_delivered_customer_date")]


def zero_checks(df: DataFrame, rules: dict[str, Column], severity: str = "CRITICAL") -> DataFrame:
    """One scan: each rule is an aggregate that must be 0. Gives check rows (all strings)."""
    agg = df.agg(*[v.cast("long").alias(k) for k, v in rules.items()])
    long = agg.unpivot([], list(rules), "check_name", "n")
    bad = "FAIL" if severity == "CRITICAL" else "WARN"
    return long.select("check_name", F.when(F.col("n") == 0, "PASS").otherwise(bad).alias("status"),
                       F.col("n").cast("string").alias("observed"), F.lit("0").alias("expected"))


def equal_check(name: str, observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Check row comparing two one-value frames."""
    o = observed.select(F.col(observed.columns[0]).cast("string").alias("observed"),
                        expected.select(F.col(expected.columns[0]).cast("string")).scalar().alias("expected"))
    return o.select(F.lit(name).alias("check_name"),
                    F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL").alias("status"),
                    "observed", "expected")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(df: DataFrame, keys: list[str]) -> Column:
    """Rows minus distinct keys; a key with a NULL part counts as a key."""
    return F.count(F.lit(1)) - F.countDistinct(F.struct(*keys))


def uniqueness_checks(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return union([zero_checks(d, {f"UNIQUE__{n}": duplicate_keys(d, k)}) for n, (d, k) in tables.items()])


def orphan_checks(relations: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    from parcelscope.operators.joins import orphans
    return union([zero_checks(orphans(child, parent, key), {f"FK__{n}": F.count(F.lit(1))})
                  for n, child, parent, key in relations])


def cast_loss(bronze: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    """Raw text is not blank but the typed value is NULL; raw and typed come from the same row."""
    return {f"CAST_LOSS__{n}": n_if(F.coalesce(F.length(F.col(n)) > 0, F.lit(False)) & F.col(n).try_cast(t).isNull())
            for n, t in columns.items()}


def range_violation(col: str, rule) -> Column:
    lo, lo_in, hi, hi_in = rule
    v = c(col)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | ((v < lo) if lo_in else (v <= lo))
    if hi is not None:
        bad = bad | ((v > hi) if hi_in else (v >= hi))
    return bad


def range_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """All numeric range rules, one scan per table."""
    out = []
    for name, df in tables.items():
        rules = {f"RANGE__{t}__{col}": n_if(range_violation(col, r)) for (t, col), r in NUMERIC_RULES.items() if t == name}
        if rules:
            out.append(zero_checks(df, rules))
    return union(out)


def domain_violations(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed list with their row counts."""
    return (df.filter(F.col(col).isNotNull() & ~F.col(col).isin(allowed)).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def temporal_order(df: DataFrame) -> DataFrame:
    """Per rule: comparable rows (both times known) and violations."""
    cols = []
    for name, a, b in TEMPORAL_RULES:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        cols += [n_if(both).alias(f"{name}__both"), n_if(F.col(a) > F.col(b)).alias(f"{name}__bad")]
    agg = df.agg(*cols)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}__both").alias("comparable"),
                              F.col(f"{n}__bad").alias("violations")) for n, _, _ in TEMPORAL_RULES])
    return agg.select(F.inline(rows))


def exception_rows(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Offending rows, one per violated check, tagged with the check."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in checks.items()]))
    return df.select(key, F.explode(tags).alias("dq_check"))


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Sum over identical rows of (copies - 1)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def scorecard(checks: DataFrame) -> DataFrame:
    """PASS / FAIL / WARN counts and the gate status."""
    n = {s: n_if(F.col("status") == s) for s in ("PASS", "FAIL", "WARN")}
    return checks.agg(F.count(F.lit(1)).alias("checks"), *[v.alias(k.lower()) for k, v in n.items()],
                      F.when(n["FAIL"] > 0, "FAIL").otherwise("PASS").alias("gate_status"))


def require_pass(previous: DataFrame) -> None:
    """A gate runs only when the one before it passed (``previous`` is a scorecard: one row)."""
    status = previous.select("gate_status").first()[0]
    if status != "PASS":
        raise RuntimeError(f"previous gate is {status}")


def schema_diff(df: DataFrame, expected: list[str]) -> dict:
    """Missing and extra columns, and whether the order matches."""
    have = df.columns
    return {"missing": [x for x in expected if x not in have], "extra": [x for x in have if x not in expected],
            "same_order": have == expected}


def dtype_conformity(bronze: DataFrame, types: dict[str, str]) -> DataFrame:
    """Share of non-blank text that casts to the declared type, one scan."""
    aggs = []
    for n, t in types.items():
        text = F.coalesce(F.length(n) > 0, F.lit(False))
        aggs += [n_if(text).alias(f"{n}__v"), n_if(text & F.col(n).try_cast(t).isNotNull()).alias(f"{n}__ok")]
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("declared"), F.col(f"{n}__v").alias("values"),
                              F.col(f"{n}__ok").alias("castable")) for n, t in types.items()])
    return bronze.agg(*aggs).select(F.inline(rows))


def reconciliation(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Absolute difference bands of two totals per key (0.01, 1 and 10)."""
    d = left.select(key, a).join(right.select(key, b), key)
    gap = F.round(F.abs(F.col(a) - F.col(b)), 4)
    band = (F.when(gap <= 0.01, "<=0.01").when(gap <= 1, "<=1").when(gap <= 10, "<=10").otherwise(">10"))
    return d.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("orders"), rnd(F.sum(gap), 4).alias("total_gap"))
