"""Sources and sinks: driver tables, file systems, object listings and the repository."""
