"""Fixed reports and listings over the stored tables."""
