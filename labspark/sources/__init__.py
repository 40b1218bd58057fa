"""Input contracts, typed scans, sinks and the adapters used by the registered queries."""
