"""Column functions: text, affixes, hours of the day, rendering."""
