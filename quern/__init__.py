"""quern: a Spark engine for event-sourced work-queue logs."""
