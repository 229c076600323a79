"""Sources: diffs, manifests, reference lists, corpora, requests."""
