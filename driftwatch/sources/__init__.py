"""Event tables and payloads that the catalogued queries read."""
