"""mnemix: text memory, retrieval and decision analytics as Spark DataFrame pipelines."""
