"""Shop analytics as Spark jobs: reports, stock ledgers, allocation, ingest, series and forecasts."""
