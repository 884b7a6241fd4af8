"""Stream-file ledger analytics as Spark DataFrame operators."""
