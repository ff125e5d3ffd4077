"""Tools run from the command line."""
