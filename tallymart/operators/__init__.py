"""DataFrame-to-DataFrame steps: deduplication, rules, marts, report rollups."""
