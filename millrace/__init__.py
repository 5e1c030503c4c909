"""Raw feeds to curated tables, and row enrichment, on stock Spark."""
