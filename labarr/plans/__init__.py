"""Plan-time objects: label indexes and position picks. Nothing here runs a Spark job."""
