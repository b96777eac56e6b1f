"""Attendance forecasting and corpus preparation as Spark jobs."""
