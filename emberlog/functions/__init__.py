"""Column expressions: severities, texts, fingerprints."""
