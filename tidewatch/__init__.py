"""Tidewatch: water-quality monitoring for sensor fleets, written as Spark jobs."""
