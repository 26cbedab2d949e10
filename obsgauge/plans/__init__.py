"""Rule catalogue and the end-to-end flows built from the operators."""
