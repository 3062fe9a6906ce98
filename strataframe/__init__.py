"""Case-control cohort analytics as DataFrame-to-DataFrame functions on Spark."""
