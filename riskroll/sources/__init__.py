from riskroll.sources.files import (  # noqa: F401
    allowlist_names,
    common_type,
    read_parquet,
    read_in_order, read_with_lineage,
    select_allowlist,
    union_relaxed,
    union_strict,
    write_csv,
    write_parquet,
)
