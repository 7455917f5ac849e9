"""sparkcurate: trustworthy labelled datasets and honest model reports as Spark DataFrame jobs."""
