"""Spark-native analytics for robot evaluation logs: intervals, sequential tests, guards, judges, fingerprints and regression diffs."""
