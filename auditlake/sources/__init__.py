"""Where files come from: trees, tables, snapshots."""
