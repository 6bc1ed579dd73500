"""Sources and sinks: table scans, CSV with missing tokens, prediction store,
experiment log and parameter files."""
