"""Rule-based audit of table partitions, buckets and definitions, for a whole fleet at once."""
