"""Column builders: timing rules, labels, axes, group keys, bit and confidence helpers."""
