"""kindling: find problems worth solving in user-reaction data, as Spark jobs."""
