"""DataFrame operators: matching, routing, dedup, throttling, caps, reports."""
