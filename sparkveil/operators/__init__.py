"""DataFrame operators: detection, redaction, sessions, records, profiles, evaluation, person names."""
