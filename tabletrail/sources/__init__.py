"""External tables, project files, manifests and producers as DataFrames."""
