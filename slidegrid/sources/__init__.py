"""Sources and sinks: worklists, annotations, replies and result files."""
