"""Sources and sinks: log lines, threat feeds, event and alert tables, configuration, sample logs."""
