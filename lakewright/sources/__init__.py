"""Sources and sinks: registry, bronze landing, versioned table store."""
