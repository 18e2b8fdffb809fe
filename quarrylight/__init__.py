"""Security log analytics on Spark: parsing, enrichment, detection rules and event queries."""
