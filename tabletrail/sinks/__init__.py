"""Published tables, deliverable bundles, manifests and cached stages."""
