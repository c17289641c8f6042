"""Readers and writers."""

from creditspark.sources.buckets import open_buckets, write_buckets
from creditspark.sources.delimited import read_origination, read_performance, read_pipe, read_quarterly
from creditspark.sources.ledger import file_ledger
from creditspark.sources.quarters import append_delivery, read_deliveries
from creditspark.sources.tables import read_csv_table, read_table, write_csv, write_table

__all__ = [
    "append_delivery", "file_ledger", "open_buckets", "read_csv_table", "read_deliveries", "read_origination",
    "read_performance", "read_pipe", "read_quarterly", "read_table", "write_buckets", "write_csv", "write_table",
]
