"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local executor threads (default 8)
"""

import json
import os
import time

from tidewatt.catalog.all import QUERIES
from tidewatt.session import build_session, remove_stages

HEADLINES = [
    "c5_hourly_strain_by_type",
    "g1_g2_g3_hourly_filled",
    "g1_g2_g3_nation_filled",
    "w1_lags",
    "w2_rolling_means",
    "j1_weather_onto_many_series",
    "j3_hour_mean_fallback",
    "p12_model_dataset",
    "a4_a5_a6_forecast_errors_by_type",
    "a7_threshold_of_line_items",
    "a15_year_completeness_by_nation",
    "q3_gaps",
    "m5_lag_ridge_fit_by_nation",
    "m8_mlp_scoring_fixed_weights",
    "e1_e2_metrics_table",
    "e1_all_models_by_nation",
    "c3b_c4_linear_within_year",
    "c5_scenario_strain",
    "r2_peak_window",
    "r6_report_facts",
    "m7_mlp_training",
    "q12_series_report",
    "s3_p20_p21_weather_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidewatt-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    # start the executor threads and load Spark's classes on the smallest tables
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        QUERIES[HEADLINES[0]](spark, small).collect()
    # building a query may write stages or train; running it gives the rows
    seconds, building = {}, {}
    for name in HEADLINES:
        began = time.perf_counter()
        built = QUERIES[name](spark, sf_dir)
        building[name] = round(time.perf_counter() - began, 3)
        built.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        remove_stages(spark)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "building": building,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
