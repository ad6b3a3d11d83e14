"""accesslens: behavioural analytics over access-event logs, as Spark jobs."""
