from riskroll.streaming.incremental import run_incremental_f1, running_counts, with_f1  # noqa: F401
