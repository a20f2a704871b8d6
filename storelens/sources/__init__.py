"""Sources and sinks: driver tables, test-table adapters, file scans, writers."""
