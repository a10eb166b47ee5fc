"""Sources and sinks: driver tables, fixture views, CSV/Parquet files, stores."""

from buyerlens.sources.tables import read_table  # noqa: F401
