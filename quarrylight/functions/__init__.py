"""Column functions: event fields, numbers, durations, addresses, regular expressions."""
