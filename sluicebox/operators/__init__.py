"""Sub-package of the data-quality engine."""
