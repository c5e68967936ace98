"""Point-in-time research, risk gates, backtests and alerts as Spark jobs."""
