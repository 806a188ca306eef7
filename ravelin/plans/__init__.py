"""Plan-level helpers: lineage cuts and size-checked joins."""
