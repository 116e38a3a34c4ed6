"""Statistical observations on Spark: ingest, clean, analyse, export."""
