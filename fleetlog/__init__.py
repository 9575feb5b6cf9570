"""fleetlog: change logs, presence, roll-ups and time-lines of keyed entities on Spark."""
