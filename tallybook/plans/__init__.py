"""The named computations: collate, enrich, report and profile."""
