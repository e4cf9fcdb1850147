"""Rule tables, pattern translation and size-checked joins."""
