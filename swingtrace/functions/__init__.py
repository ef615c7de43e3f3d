"""Column builders: metrics, order statistics, masks, text."""
