"""Sub-plans that several operators share."""
