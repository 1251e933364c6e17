"""Rule specifications, profiling, applying, and the registered queries."""
