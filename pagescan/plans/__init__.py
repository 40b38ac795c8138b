"""Multi-step scans built from the operators."""
