"""From findings to edit plans."""
