"""DataFrame -> DataFrame operators; use them with ``DataFrame.transform``."""
