"""Stateless scoring and incremental semivariograms on streams."""
