"""Row-local ``Column -> Column`` functions."""
