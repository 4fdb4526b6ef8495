"""Event-log closure, replay and evaluation operators for price-feed forensics on Spark."""
