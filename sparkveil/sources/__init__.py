"""Sources and sinks: strict text files, CoNLL, JSON."""
