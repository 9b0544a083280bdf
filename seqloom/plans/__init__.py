"""Command line and pipelines of commands."""
