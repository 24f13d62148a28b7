"""Sources and sinks: recordings, stage files, tables of peaks."""
