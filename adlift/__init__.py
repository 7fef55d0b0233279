"""adlift: launch-impact analytics as Spark DataFrame plans.

Public entry points:

* :class:`adlift.config.LaunchConfig` — dates, thresholds, rules;
* :class:`adlift.sources.Sources` — the nine source tables;
* :mod:`adlift.plans.extracts` — the five extracts;
* :mod:`adlift.plans.kpis` and :mod:`adlift.plans.report` — KPI tables,
  top-N tables, quality checks, JSON bundle and the whole job
  (:func:`adlift.plans.report.run_report`);
* :mod:`adlift.functions` — the classifiers as Column functions.
"""

from .config import FIXTURE_CONFIG, LaunchConfig, windows
from .sources import Sources

__all__ = ["FIXTURE_CONFIG", "LaunchConfig", "Sources", "windows"]
