"""featurespark — feature engineering and data profiling as Spark DataFrame jobs.

Entry points:
  operators.transforms.apply_transforms / fit_transforms   single transforms (X2)
  plans.chain.build_chain / apply_and_write                chained model-ready table (X3, X4, X7)
  operators.profile.profile                                 full profile (P1–P19)
  operators.balance.balance_table / random_oversample       balancing (B1–B14), operators.smoter.smoter
  operators.leakage.leakage_report / leakage_summary        leakage (L1–L4)
  operators.recommend.recommendations / column_report       recommendations (F1, F2)
  sources.io, sources.history                               scans, sinks, run history (S*, R*)
  streaming.apply                                           fitted transforms on a stream
"""

__version__ = "0.1.0"
