"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parcelscope.plans import catalog  # noqa: E402
from parcelscope.session import build_session  # noqa: E402

HEADLINE = ["e7_monthly_label_rates", "c4_supervised_core", "c11_exact_quantiles", "c15_seller_volume_bands", "d14_numeric_ranges",
            "d23_numeric_profile", "d32_missing_reasons", "g1_seller_history", "g7_freight_curve_by_month", "h10_order_routes",
            "i6_order_expected", "i11_monthly_robust_z", "i22_critical_friction", "j1_spearman_pairs", "j10_logit_nested",
            "k4_average_precision", "k7_recall_at_fraction", "k16_calibration_error", "k12_max_t_band", "k24_functional_basis"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "parcelscope-bench", **{"spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false",
                                                                    "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
