"""Spark jobs that plan shared commuter transport for many sites at once."""
