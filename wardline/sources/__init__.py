"""Sources and sinks."""

from .csv_dir import load_csv_dir, read_csv_table
from .schemas import SCHEMAS
from .sinks import write_csv, write_parquet
from .tables import frame_sql, register_views, warehouse_table

__all__ = [
    "SCHEMAS",
    "frame_sql",
    "load_csv_dir",
    "read_csv_table",
    "register_views",
    "warehouse_table",
    "write_csv",
    "write_parquet",
]
