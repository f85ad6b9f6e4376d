"""Plans over the driver's tables: one registered query each."""
