"""Engine core: contexts, stage registry, pipeline specs, and shared-folder storage."""
