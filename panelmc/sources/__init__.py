"""Where panels come from: tables bound as realizations, steps, lookups and arrays."""
