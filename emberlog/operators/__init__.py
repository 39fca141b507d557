"""DataFrame operators over the canonical ``logs`` schema."""
