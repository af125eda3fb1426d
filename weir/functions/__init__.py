"""Part of weir."""
