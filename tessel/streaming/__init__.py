"""Logs as streams. The batch functions of sources.logs define the results; these keep them up to date."""
