"""Spark-native review of untrusted agent-tool documentation and agent behaviour."""
