"""Part of the photosluice engine."""
