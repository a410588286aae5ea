"""Progressive runs and stateful rules on streams."""
