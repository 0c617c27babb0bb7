"""tickloom: intraday market analytics as composable PySpark DataFrame operators."""
