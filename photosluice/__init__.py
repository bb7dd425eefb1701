"""photosluice: curating large pools of time-stamped, scored and embedded records on Spark."""

__version__ = "0.1.0"
