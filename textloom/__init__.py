"""Text corpora, and the networks around them, as composable Spark DataFrame operators."""
