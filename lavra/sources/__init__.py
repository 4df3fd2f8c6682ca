from lavra.sources.tables import calendar, grid, markdown, read_table, scan, small_table, write_report

__all__ = ["calendar", "grid", "markdown", "read_table", "scan", "small_table", "write_report"]
