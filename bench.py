"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Setup (not timed): the fixture fact is written once to Parquet in a fresh
folder under the shared checkpoint folder, range-partitioned and sorted by
date — the production layout, where date windows skip files through
Parquet statistics / partition pruning.  Dimensions stay lazy views.

Every query runs once to warm up, then ``$BENCH_REPS`` interleaved rounds
run each query once into the ``noop`` sink; the median is reported.  ``value`` is the sum of the
medians of the five optimised extracts plus the KPI set (the cache write,
which re-runs the extracts, is reported but not added); the plain forms are
extract is the baseline for its optimised form").

Prints one JSON line.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402

from adlift.config import FIXTURE_CONFIG as CFG  # noqa: E402
from adlift.plans import kpis, plain, report  # noqa: E402
from adlift.plans.extracts import EXTRACTS  # noqa: E402
from adlift.session import build_session, scratch_path  # noqa: E402
from adlift.sources import fixture_frames, read_extracts, write_extracts  # noqa: E402
from adlift.sources.registry import Sources  # noqa: E402


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _interleaved(runs: dict, reps: int) -> dict[str, float]:
    """One warm-up round over every query, then ``reps`` rounds that run each
    query once (so JIT warm-up and GC affect all of them alike); medians."""
    for fn in runs.values():
        fn()
    times: dict[str, list[float]] = {k: [] for k in runs}
    for _ in range(reps):
        for k, fn in runs.items():
            t = time.perf_counter()
            fn()
            times[k].append(time.perf_counter() - t)
    return {k: round(statistics.median(v), 3) for k, v in times.items()}


def _kpi_set(ext) -> dict:
    """Builders of the KPI / report tables (each timed run builds and runs one)."""
    e, d, a, n, i = ext["enet"], ext["aw_denom"], ext["arpu"], ext["nuevos"], ext["iab"]
    return {
        "kpi_advertiser_summary": lambda: kpis.kpi_advertiser_summary(e),
        "kpi_volume_by_inventory": lambda: kpis.kpi_volume_by_inventory(e),
        "kpi_population_totals": lambda: kpis.kpi_population_totals(d),
        "kpi_adoption_rates": lambda: kpis.kpi_adoption_rates(e, d),
        "kpi_adopter_deltas": lambda: kpis.kpi_adopter_deltas(a),
        "kpi_endemic_arpu": lambda: kpis.kpi_endemic_arpu(a),
        "kpi_endemic_incremental": lambda: kpis.kpi_endemic_incremental(a),
        "kpi_endemic_cannibalised": lambda: kpis.kpi_endemic_cannibalised(a, CFG),
        "kpi_nonendemic_opportunity": lambda: kpis.kpi_nonendemic_opportunity(a, d),
        "kpi_nonendemic_adoption": lambda: kpis.kpi_nonendemic_adoption(a, d),
        "kpi_first_time_counts": lambda: kpis.kpi_first_time_counts(n),
        "kpi_creative_adoption": lambda: kpis.kpi_creative_adoption(i),
        "top_endemic_adopters": lambda: report.top_endemic_adopters(a, CFG),
        "top_opportunities": lambda: report.top_opportunities(a, d),
        "top_nonendemic_adopters": lambda: report.top_nonendemic_adopters(a),
        "list_first_time_adx": lambda: report.list_first_time_adx(n),
        "list_first_time_dsp": lambda: report.list_first_time_dsp(n),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="adlift-bench")

    frames = fixture_frames(spark, sf_dir)
    t0 = time.perf_counter()
    fact_path = scratch_path(spark, "bench-fact")
    n_files = max(cpus, 8)
    (
        frames["daily_metrics"]
        .repartitionByRange(n_files, "event_local_dt")
        .sortWithinPartitions("event_local_dt")
        .write.mode("overwrite")
        .parquet(fact_path)
    )
    frames["daily_metrics"] = spark.read.parquet(fact_path)
    src = Sources.from_frames(frames)
    fact_rows = src.daily_metrics.count()
    setup_sec = round(time.perf_counter() - t0, 3)

    cache = scratch_path(spark, "bench-extracts")
    t = time.perf_counter()
    write_extracts({k: f(src, CFG) for k, f in EXTRACTS.items()}, cache)
    write_sec = round(time.perf_counter() - t, 3)
    # as in run_report: the cached extracts are kept in memory for the KPI set
    ext = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in read_extracts(spark, cache).items()}

    runs = {f"{k}": (lambda fn=fn: _noop(fn(src, CFG))) for k, fn in EXTRACTS.items()}
    builders = _kpi_set(ext)
    kpi_names = list(builders)
    for name, build in builders.items():
        runs[name] = lambda build=build: _noop(build())
    runs["arpu_plain"] = lambda: _noop(plain.ext_adopters_plain(src, CFG))
    runs["nuevos_plain"] = lambda: _noop(plain.ext_first_time_plain(src, CFG))
    med = _interleaved(runs, reps)

    q = {k: med[k] for k in EXTRACTS}
    q["kpi_set_from_cache"] = round(sum(med[k] for k in kpi_names), 3)
    headline = sum(q.values())
    q["write_extract_cache"] = write_sec
    base = {k: med[k] for k in ("arpu_plain", "nuevos_plain")}

    # on request (BENCH_JOBS=1), the whole job, once with an empty fold store and once with the store kept:
    # the second run reads the fact for the last day only
    fold_root, jobs = scratch_path(spark, "bench-fold"), {}
    for name in ("run_report_first", "run_report_next_day") if os.environ.get("BENCH_JOBS") else ():
        t = time.perf_counter()
        report.run_report(src, CFG, scratch_path(spark, "bench-report"), fold_root=fold_root, late_days=int(name != "run_report_first"))
        jobs[name] = round(time.perf_counter() - t, 3)

    def scans(df) -> int:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        return sum(1 for line in buf.getvalue().splitlines() if line.startswith("Location:") and "bench-fact" in line)

    fact_scans = {
        "arpu": scans(EXTRACTS["arpu"](src, CFG)),
        "arpu_plain": scans(plain.ext_adopters_plain(src, CFG)),
        "nuevos": scans(EXTRACTS["nuevos"](src, CFG)),
        "nuevos_plain": scans(plain.ext_first_time_plain(src, CFG)),
    }

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "extracts_plus_kpis_median_sum",
        "value": round(headline, 3),
        "unit": "sec",
        "queries": q,
        "baseline_plain_forms": base,
        "kpi_tables": {k: med[k] for k in kpi_names},
        "jobs": jobs,
        "fact_scans_per_query": fact_scans,
        "fact_rows": fact_rows,
        "setup_sec": setup_sec,
        "reps": reps,
        "cpus": cpus,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
