"""Named questions and the registered queries."""
