"""Text operators for training data. Optional: nothing outside this package imports it."""
